"""
Benchmark passages within documents: a prefix-filtered join of word shingles with exact verification.

Words are runs of digits, a-z after lower-casing A-Z, and characters beyond ASCII. A window is `WINDOW` consecutive words of an item, or all
of an item that has fewer. A document word inside any occurrence of a window is hit.

A window occurs where all its shingles (`SHINGLE` words, or the whole window if it is shorter) stand one after the other:

1. Every position of every document is matched with the shingles of the benchmark; what matches is kept with its place. The
   benchmark's shingles are broadcast while there are at most `BROADCAST` of them, and joined by shuffle beyond that. A row of a
   position holds its own shingle, never the words of the whole text.
2. The matches give each shingle's frequency over all documents. Of a window, the rarest shingle is the necessary prefix: where it
   is absent, so is the window.
3. Occurrences of prefixes are candidates, if the window fits into the document at that place.
4. A candidate stands if all shingles of its window match, word for word, at their offsets.

Only DataFrame functions run on documents. Null and empty texts have no words; items without words have no window. Null item
ids count as no item, though their words are hit. Repeated items are one item. Equal rows have equal results. Empty
tables are allowed on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common

WINDOW, SHINGLE = 13, 3
BROADCAST = 1_000_000
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
KEY = ["key_id", "key_hash"]


def words(text: Column) -> Column:
    """The words of a text; null and empty texts have none."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def windows(benchmark: DataFrame) -> DataFrame:
    """(window, item_id, length): the windows of (item_id, text), each as its words joined by spaces."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(WINDOW))
    starts = items.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("start"))
    return starts.select(F.array_join(F.expr("slice(words, start, length)"), " ").alias("window"), "item_id", "length").distinct()


def shingles(found: DataFrame) -> DataFrame:
    """(window, length, offset, width, shingle) of distinct windows."""
    distinct = found.select("window", "length").distinct().select("window", "length", F.split("window", " ").alias("words"), F.least("length", F.lit(SHINGLE)).alias("width"))
    spread = distinct.select("*", F.explode(F.expr("sequence(0, length - width)")).alias("offset"))
    return spread.select("window", "length", "offset", "width", F.expr("slice(words, offset + 1, width)").alias("parts"))


def matches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key_id, key_hash, position, shingle, n_words): where shingles of `wanted` (width, parts) stand in documents."""
    wanted = common.written(wanted.select("width", F.xxhash64("parts").alias("hash"), F.array_join("parts", " ").alias("shingle")).distinct(), "bench-shingles")
    widths = sorted(r.width for r in wanted.select("width").distinct().collect())  # at most SHINGLE of them
    hashes = wanted.select("hash").distinct()
    if hashes.count() <= BROADCAST:
        hashes = F.broadcast(hashes)
    texts = common.row_keys(docs).select(*KEY, words(F.col("text")).alias("words")).select("*", F.size("words").alias("n_words"))
    found = None
    for width in widths or [SHINGLE]:
        ahead = F.arrays_zip(*(F.slice("words", k + 1, F.col("n_words")).alias(f"w{k}") for k in range(width)))
        places = texts.select(*KEY, "n_words", F.posexplode(ahead).alias("position", "own")).where(F.col("position") + width <= F.col("n_words"))
        own = [F.col("own")[f"w{k}"] for k in range(width)]
        hashed = places.select(*KEY, "position", F.xxhash64(F.array(*own)).alias("hash"), F.concat_ws(" ", *own).alias("shingle"), "n_words")
        kept = hashed.join(hashes, "hash").select(*KEY, "position", "shingle", "n_words")
        found = kept if found is None else found.union(kept)
    return found


def occurrences(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key_id, key_hash, start, length, window): where the windows of `found` occur in documents."""
    parts = shingles(found)
    placed = common.written(matches(docs, parts), "bench-matches")
    parts = common.written(parts.select("window", "length", "offset", F.array_join("parts", " ").alias("shingle")), "bench-parts")
    frequency = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    ranked = parts.join(frequency, "shingle", "left").groupBy("window", "length").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "shingle")).alias("prefix"), F.count(F.lit(1)).alias("n_parts"),
    )
    prefix = common.written(ranked.where("prefix.n > 0").select("window", "length", "n_parts", "prefix.offset", "prefix.shingle"), "bench-prefix")
    candidates = placed.join(prefix, "shingle").select(*KEY, (F.col("position") - F.col("offset")).alias("start"), "length", "window", "n_parts", "n_words")
    candidates = candidates.where("start >= 0 and start + length <= n_words").distinct()
    # every shingle of a candidate, where it has to stand
    due = candidates.join(parts.select("window", "offset", "shingle"), "window").withColumn("position", F.col("start") + F.col("offset"))
    stands = due.join(placed.select(*KEY, "position", "shingle").distinct(), [*KEY, "position", "shingle"], "left_semi")
    whole = stands.groupBy(*KEY, "start", "length", "window").agg(F.count(F.lit(1)).alias("n"), F.first("n_parts").alias("n_parts"))
    return common.written(whole.where("n = n_parts").drop("n", "n_parts"), "bench-found")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row key of (doc_id, text) with any window: key_id, key_hash, n_hit, n_items, item_ids (as strings, sorted)."""
    found = common.written(windows(benchmark), "bench-windows")
    at = occurrences(docs, found)
    hit = at.select(*KEY, F.explode(F.expr("sequence(start, start + length - 1)")).alias("position")).distinct()
    hit = hit.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_hit"))
    items = at.select(*KEY, "window").distinct().join(found.select("window", F.col("item_id").cast("string").alias("item_id")), "window")
    items = items.groupBy(*KEY).agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return hit.join(items, KEY).select(*KEY, "n_hit", F.size("item_ids").cast("long").alias("n_items"), "item_ids")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of a table with doc_id and text that are not contaminated."""
    found = contamination(docs, benchmark).select(*KEY, "n_hit")
    rows = common.packed(docs).join(found, KEY, "left")
    # words are counted where any is hit
    return rows.where(F.when(F.col("n_hit").isNull(), True).otherwise(~contaminated(F.col("n_hit"), F.size(words(F.col("row.text")))))).select("row.*")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, common.read(spark, sf_dir, "benchmark"))
    counted = common.keyed(docs).select("doc_id", *KEY, F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return counted.join(found, KEY, "left").select(
        "doc_id", "n_words", n_hit.cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join(F.coalesce("item_ids", F.array().cast("array<string>")), ","), "UTF-8"), 256).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), n AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM i WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS window_text FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM n)
), pos AS (
  SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS window_text
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d), (SELECT DISTINCT k FROM n) WHERE s + k - 1 <= len(w)
), occ AS (
  SELECT DISTINCT r, s, pos.k, item_id FROM pos JOIN win USING (window_text)
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM occ) GROUP BY r
), its AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
