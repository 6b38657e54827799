"""
WARC archives: written with an index, read through it.

`write` stores every page as one record, a gzip member of its own, and returns the index: one row per record with file,
offset, length, URL and payload digest. Of records with equal payloads of at least `REVISIT_BYTES` bytes, the one with the
smallest page_id is a response and the others are revisits that refer to it and hold only the HTTP head.
`read` takes index rows (all or a selection): it sorts them by file and offset, deals out ranges of them, joins neighbouring
byte ranges into one read, and parses the records.

Which pages are revisits is settled by an aggregate of (digest, smallest page_id) joined back to the pages; copies combine
before the shuffle. The aggregate is a table of its own, so that a digest that a third of the pages share can be split by the
adaptive skew join: it takes only joins with an exchange on both sides.

Null html is an empty payload, a null URL an empty one. Equal rows give a record each; rows that repeat the smallest page_id of
their payload are all responses. A payload whose pages all lack an id has only responses; a page without id that
repeats a page with one is a revisit. An empty table gives no file and no row. Further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common

REVISIT_BYTES = 100
FILE_BYTES = 1 << 28
#: Bytes between two records that are read rather than skipped, and the most one read fetches unless a record is larger.
GAP_BYTES, READ_BYTES = 1 << 16, 1 << 23
INDEX = "path string, offset long, length long, page_id long, url string, digest string"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str, digest: str, payload: bytes, first: int | None) -> bytes:
    """One WARC record; a revisit of page `first` if that is given."""
    clean = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {clean}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if first is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; the first line is left out."""
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(raw: bytes) -> dict:
    """What one uncompressed record says, checked against its own lengths and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, full = warc["warc-payload-digest"].removeprefix("sha256:"), int(fields(http)["content-length"])
    number = lambda name: int(n) if (n := warc.get(name, "").removeprefix("<urn:page:").removesuffix(">")) else None
    if warc["warc-type"] == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {number('warc-record-id')}")
    return {
        "page_id": number("warc-record-id"), "url": warc["warc-target-uri"], "payload_bytes": full, "payload_digest": digest,
        "record_type": warc["warc-type"], "refers_to": number("warc-refers-to"), "payload": payload if warc["warc-type"] == "response" else None,
    }


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of (page_id, url, html) in `folder`; returns their index, itself a table in the shared folder."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"size": F.octet_length("payload"), "digest": F.sha2("payload", 256)})
    shared = (
        rows.where(F.col("size") >= REVISIT_BYTES).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    )
    typed = rows.join(common.written(shared, "warc-shared"), "digest", "left").withColumn("first", F.expr("if(page_id <=> first, null, first)"))

    def store(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, inner = common.filesystem(folder)
        fs.create_dir(inner, recursive=True)
        out, path, at = None, "", 0
        for frame in frames:
            index = []
            for page_id, url, payload, digest, first in zip(frame["page_id"].astype(object), frame["url"], frame["payload"], frame["digest"], frame["first"].astype(object), strict=True):
                if out is None or at >= file_bytes:
                    if out:
                        out.close()
                    path, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(common.filesystem(path)[1], compression=None)
                page_id, first = (None if pd.isna(x) else int(x) for x in (page_id, first))
                member = gzip.compress(record(page_id, url, digest, bytes(payload), first), 6, mtime=0)
                out.write(member)
                index.append((path, at, len(member), page_id, url, digest))
                at += len(member)
            yield common.frame(index, ["path", "offset", "length", "page_id", "url", "digest"], ["page_id"])
        if out:
            out.close()

    # whole ids as strings: pandas would turn a column of longs with nulls into floats
    return common.written(_exact(typed.select("page_id", "url", "payload", "digest", "first")).mapInPandas(store, INDEX), "warc-index")


def _exact(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in ("page_id", "first")})


def ranges(offsets: list[int], lengths: list[int], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """(first record, record after the last, end byte) of each read over records of one file in order of offset."""
    out, k = [], 0
    while k < len(offsets):
        end, n = offsets[k] + lengths[k], k + 1
        while n < len(offsets) and offsets[n] - end <= gap and offsets[n] + lengths[n] - offsets[k] <= most:
            end, n = max(end, offsets[n] + lengths[n]), n + 1
        out.append((k, n, end))
        k = n
    return out


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(index: DataFrame, n_tasks: int, payloads: bool = True) -> DataFrame:
    """The records of the index rows; `payloads=False` leaves payloads out after checking them."""
    order = ["path", "offset"]
    selected = index.select("path", "offset", "length").repartitionByRange(n_tasks, *order).sortWithinPartitions(*order)

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part in frame.groupby("path", sort=False):
                fs, inner = common.filesystem(path)
                offsets, lengths = part["offset"].tolist(), part["length"].tolist()
                with fs.open_input_file(inner) as file:
                    for first, after, end in ranges(offsets, lengths):
                        start = offsets[first]
                        data = memoryview(file.read_at(end - start, start))
                        found = [parse(gzip.decompress(data[o - start : o - start + n])) for o, n in zip(offsets[first:after], lengths[first:after], strict=True)]
                        out = common.frame([[*r.values()] for r in found], [*found[0]], ["page_id", "refers_to"])
                        yield out if payloads else out.assign(payload=None)

    return selected.mapInPandas(load, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, then every record read back through the index."""
    index = write(common.read(spark, sf_dir, "pages"), common.new_folder(spark, "warc"))
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return read(index, common.tasks_for(spark, size, 1 << 25), payloads=False).drop("payload", "url")


SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id, count(*) AS n FROM p WHERE payload_bytes >= 100 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN n > 1 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
