"""
Shards of documents by extendible hashing.

A document's address is a 48-bit hash of its id. The directory starts as one bucket; every bucket above the byte limit splits on the next
bit of the address, and only those, until each fits. A shard is named by its bits, so a directory of 2^depth entries, of which
several may share a shard, finds it from the leading bits of an address.

Sizes are summed per address first, so the rounds read one narrow row per distinct address: a round per bit, each with the
buckets that are still too large. The directory has as many rows as there are shards.

A bucket whose rows all have one address can't split by bits. Where such a bucket is above the limit, because one document is or
because an id repeats, it is a shard over the limit, or, if it has several rows, its rows get `REPEAT_BITS` random bits more and split by those in
the same way. The bits are drawn once and kept in the shared folder.

Null ids are an id of their own; null texts have no bytes. Equal rows may go to different shards only where their id alone exceeds the
limit. An empty table gives no row and no shard.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common

LIMIT = 16 << 20
BITS, REPEAT_BITS = 48, 16
#: The deepest directory that is broadcast: 65,536 entries at most.
DIRECTORY_BITS = 16
ADDRESS = "lpad(conv(substr(md5(coalesce(cast(doc_id as string), 'null')), 1, 12), 16, 2), 48, '0')"


def directory(sizes: DataFrame, limit: int, bits: int) -> DataFrame:
    """(shard, depth, bytes, docs): the buckets of (address, bytes, docs), an address being a string of `bits` binary digits."""
    open_, done = sizes, []
    for depth in range(bits + 1):
        bucket = F.substring("address", 1, depth) if depth else F.lit("")
        totals = open_.groupBy(bucket.alias("shard")).agg(F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"))
        totals = common.written(totals.withColumn("depth", F.lit(depth)), "shard-round")
        fits = (F.col("bytes") <= limit) | F.lit(depth == bits)
        done.append(totals.where(fits).select("shard", "depth", "bytes", "docs"))
        large = totals.where(~fits).select("shard")
        if large.isEmpty():
            break
        open_ = common.written(open_.withColumn("shard", bucket).join(large, "shard", "left_semi").drop("shard"), "shard-open")
    return reduce(DataFrame.union, done)


def assigned(docs: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """Rows of a table with doc_id and text as (row, shard, depth), and the directory (shard, depth, bytes, docs)."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).select("row", F.expr(ADDRESS.replace("doc_id", "row.doc_id")).alias("address"), F.coalesce(F.octet_length("row.text"), F.lit(0)).cast("long").alias("bytes"))
    sizes = common.written(rows.groupBy("address").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-sizes")
    crowded = common.written(sizes.where((F.col("bytes") > limit) & (F.col("docs") > 1)).select("address", F.lit(True).alias("crowded")), "shard-crowded")
    if not crowded.isEmpty():
        # more bits for the rows of such an id: a random place per row, settled in the shared folder, as equal rows have nothing to tell them apart
        marked = rows.join(crowded, "address", "left")
        more = F.lpad(F.conv(F.floor(F.rand(7) * (1 << REPEAT_BITS)).cast("string"), 10, 2), REPEAT_BITS, "0")
        rows = common.written(marked.withColumn("address", F.concat("address", F.when(F.col("crowded"), more).otherwise("0" * REPEAT_BITS))).drop("crowded"), "shard-rows")
        sizes = common.written(rows.groupBy("address").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("docs")), "shard-sizes")
        bits = BITS + REPEAT_BITS
    else:
        bits = BITS
    found = common.written(directory(sizes, limit, bits), "shard-directory")
    depths = [r.depth for r in found.select("depth").distinct().orderBy("depth").collect()]  # at most one per bit
    deepest = max(depths, default=0)
    if deepest <= DIRECTORY_BITS:
        # the directory: an entry for each value of the leading bits, several of which may share a shard
        spread = found.select("shard", "depth", F.explode(F.expr(f"sequence(0L, cast(shiftleft(1L, {deepest} - depth) as bigint) - 1L)")).alias("k"))
        entries = spread.select("shard", "depth", F.expr(f"concat(shard, lpad(conv(k, 10, 2), {deepest} - depth, '0'))").alias("entry"))
        at = rows.withColumn("entry", F.substring("address", 1, deepest) if deepest else F.lit(""))
        return at.join(F.broadcast(entries), "entry").select("row", "shard", "depth"), found
    # a few addresses hold so much that the directory would be too large; each address has exactly one of these beginnings in it
    keys = F.array(*(F.substring("address", 1, d) if d else F.lit("") for d in depths)) if depths else F.array(F.lit(""))
    homes = sizes.select("address", F.explode(keys).alias("shard")).join(found.select("shard", "depth"), "shard")
    homes = homes.where(F.length("shard") == F.col("depth"))
    return rows.join(homes, "address").select("row", "shard", "depth"), found


def write(placed: DataFrame, folder: str) -> str:
    """One folder per shard; returns the name of the folders' column. Rows of a shard meet in one task, which a shard's limit bounds."""
    name = "in_shard"
    while name in placed.select("row.*").columns:
        name += "_"
    rows = placed.select("row.*", F.concat(F.lit("s"), "shard").alias(name))
    rows.repartition(name).write.partitionBy(name).option("compression", "zstd").parquet(folder)
    return name


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of up to 16 MB of all documents, written and read back: each document's shard, and the shard's size."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    placed, found = assigned(docs)
    folder = common.new_folder(spark, "shards")
    name = write(placed, folder)
    back = spark.read.schema(f"doc_id long, text string, {name} string").parquet(folder).select("doc_id", F.expr(f"substr({name}, 2)").alias("shard"))
    return back.join(found, "shard").select("doc_id", "shard", F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"))


def sql(limit: int = LIMIT) -> str:
    """The same by trying every depth up to 20, for tables in which no id exceeds the limit by itself."""
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, ''))::BIGINT AS n,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT), 48, '0') AS address
  FROM documents
), t AS (
  SELECT r, doc_id, k, CASE WHEN k = 0 THEN '' ELSE substr(address, 1, k) END AS shard, n FROM d, range(21) AS x(k)
), s AS (
  SELECT k, shard, sum(n)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM t GROUP BY 1, 2
)
SELECT doc_id, shard, k::INT AS depth, shard_bytes, shard_docs FROM (
  SELECT doc_id, r, t.shard, t.k, shard_bytes, shard_docs, row_number() OVER (PARTITION BY r ORDER BY t.k) AS first
  FROM t JOIN s ON t.k = s.k AND t.shard = s.shard WHERE shard_bytes <= {limit}
) WHERE first = 1
"""
