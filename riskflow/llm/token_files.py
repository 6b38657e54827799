"""
Token ids in binary files: frequency-ranked ids, byte-aligned variable-length codes, control bytes kept apart.

A file is a run of blocks. A block holds whole documents in ascending id order:

    magic "RTB1", coding (1 byte: 0 plain, 1 ranked), documents u32, tokens u64, body bytes u64
    documents x (id i64, id known u8, tokens u32)
    body: ranked = ceil(tokens / 4) control bytes, then 1 to 4 bytes per token; plain = zstd of fixed-width ids

In the ranked coding a token is its rank by corpus frequency, the most frequent id first, so common tokens take one byte.
A control byte gives the lengths of four tokens; one table lookup per control byte turns it into the mask of the bytes
that are present, and decoding is two masked copies in numpy.

Ids are encoded once (see `tiles`), into plain files cut by ranges of doc_id, each task counting its ids. The counts of all documents give the
ranks (bounded by the vocabulary); a second pass, without a shuffle, rewrites every file in the ranked coding.

Null text is an empty text. Null ids come first. Equal ids stay separate documents, in no particular order. An empty
table gives no file and no row.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import common, tiles

MAGIC, PLAIN, RANKED = b"RTB1", 0, 1
HEAD = np.dtype([("magic", "S4"), ("coding", "u1"), ("docs", "<u4"), ("tokens", "<u8"), ("body", "<u8")])
DOC = np.dtype([("id", "<i8"), ("known", "u1"), ("tokens", "<u4")])
BLOCK_TOKENS = 1 << 20
#: Entry c: which of the 16 bytes of four little-endian integers the control byte c says are present.
PRESENT = np.array([[b <= (c >> 2 * i & 3) for i in range(4) for b in range(4)] for c in range(256)], dtype=bool)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    codes = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    codes[: len(values)] = (values >= 1 << 8).astype(np.uint8) + (values >= 1 << 16) + (values >= 1 << 24)
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    mask = PRESENT[control].reshape(-1, 4)[: len(values)]
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[mask].tobytes()


def unpack(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The values that `pack` was given."""
    mask = PRESENT[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:count]
    out = np.zeros((count, 4), np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.view("<u4").reshape(-1)


@dataclass
class _Writer:
    """Appends blocks to one new file in `folder`; `code` turns the ids of a block into its coding and body."""

    folder: str
    code: Callable[[np.ndarray], tuple[int, bytes]]

    def __post_init__(self):
        fs, folder = common.filesystem(self.folder)
        fs.create_dir(folder, recursive=True)
        self.path = f"{self.folder}/{uuid.uuid4().hex}.tok"
        self.file = fs.open_output_stream(common.filesystem(self.path)[1])
        self.docs: list[tuple] = []
        self.ids: list[np.ndarray] = []
        self.waiting = self.total = self.n_docs = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.ids.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK_TOKENS:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        coding, body = self.code(np.concatenate(self.ids))
        self.file.write(np.array([(MAGIC, coding, len(self.docs), self.waiting, len(body))], HEAD).tobytes())
        self.file.write(np.array(self.docs, DOC).tobytes())
        self.file.write(body)
        self.total += self.waiting
        self.n_docs += len(self.docs)
        self.docs, self.ids, self.waiting = [], [], 0

    def close(self) -> None:
        self.flush()
        self.file.close()


def read_blocks(path: str, ranked: np.ndarray | None, width: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Documents and ids of each block in turn; `ranked` has the ids by rank."""
    import zstandard

    fs, inner = common.filesystem(path)
    with fs.open_input_stream(inner) as file:
        while head := file.read(HEAD.itemsize):
            h = np.frombuffer(head, HEAD)[0]
            if h["magic"] != MAGIC:
                raise ValueError(f"{path} is no token file")
            docs = np.frombuffer(file.read(int(h["docs"]) * DOC.itemsize), DOC)
            body, count = file.read(int(h["body"])), int(h["tokens"])
            if h["coding"] == RANKED:
                cut = -(-count // 4)
                yield docs, ranked[unpack(body[:cut], body[cut:], count)]
            else:
                yield docs, np.frombuffer(zstandard.decompress(body), width)


def _summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each id occurs, of the counts of one task."""
    total = np.zeros(0, np.int64)
    for counts in (np.asarray(c) for frame in frames for c in frame["counts"]):
        total, counts = (counts.copy(), total) if len(counts) > len(total) else (total, counts)
        total[: len(counts)] += counts
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"id": seen, "n": total[seen]})


FILES = "path string, part int, docs long, tokens long"


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, np.ndarray, np.dtype]:
    """
    Write all of (doc_id, text) as ranked token files.

    Returns the files in order of their documents (path, part, docs, tokens, start: tokens in all files before), the
    ids by rank, and the ids' type. One file per task; tasks hold ranges of doc_id.
    """
    spark = docs.sparkSession
    plain, final = common.new_folder(spark, "tokens-plain"), common.new_folder(spark, "tokens")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8").alias("text"))

    def spool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, out, counts = common.per_worker(("tiles", tokenizer), lambda: tiles.Encoder(tokenizer)), None, np.zeros(0, np.int64)

        def block(ids: np.ndarray) -> tuple[int, bytes]:
            nonlocal counts
            seen = np.bincount(ids, minlength=len(counts))
            seen[: len(counts)] += counts
            counts = seen
            return PLAIN, zstandard.compress(ids.tobytes(), 3)

        end = np.array([end_id], encoder.width)
        for chunk in tiles.chunks(batches, 1):
            out = out or _Writer(plain, block)
            ids, lengths = encoder(chunk.column(1))
            for doc_id, own in zip(chunk.column(0).to_pylist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True):
                out.add(doc_id, np.append(own, end))
        if out:
            out.close()
            row = {"path": out.path, "part": TaskContext.get().partitionId(), "docs": out.n_docs, "tokens": out.total, "counts": counts}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("counts", pa.list_(pa.int64()))]))

    # rows without an id, or with the same, may be many: any order among them is right, so they are dealt by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = texts.repartitionByRange(*order).sortWithinPartitions(order[0])
    spooled = common.written(ranges.mapInArrow(spool, f"{FILES}, counts array<long>"), "token-spool")
    # as many rows as the vocabulary has ids, from each of a few tasks
    counts = spooled.select("counts").coalesce(spark.sparkContext.defaultParallelism).mapInPandas(_summed, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    ranked = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy().astype("<u4")
    width = tiles.Encoder(tokenizer).width

    def rewrite(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = np.zeros(int(ranked.max(initial=0)) + 1, "<u4")
        rank[ranked] = np.arange(len(ranked))
        for frame in frames:
            for path, part in zip(frame["path"], frame["part"], strict=True):
                out = _Writer(final, lambda ids: (RANKED, b"".join(pack(rank[ids]))))
                for found, ids in read_blocks(path, None, width):
                    ends = np.cumsum(found["tokens"], dtype=np.int64)
                    for doc, end in zip(found, ends, strict=True):
                        out.add(int(doc["id"]) if doc["known"] else None, ids[end - doc["tokens"] : end])
                out.close()
                yield pd.DataFrame({"path": [out.path], "part": [part], "docs": [out.n_docs], "tokens": [out.total]})

    files = spooled.select("path", "part")
    files = files.repartition(max(1, files.count()), "part")
    files = common.written(files.mapInPandas(rewrite, FILES), "token-files")
    # one row per file: the sum of what stands before goes through one task
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0))), ranked, width


DECODED = "doc_id long, start long, n_tokens long, ids_crc32 long"


def decode(files: DataFrame, ranked: np.ndarray, width: np.dtype, n_files: int) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32 (of its ids as little-endian u32)."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"], strict=True):
                for docs, ids in read_blocks(path, ranked, width):
                    wide = memoryview(ids.astype("<u4").tobytes())
                    ends = np.cumsum(docs["tokens"], dtype=np.int64)
                    starts = ends - docs["tokens"]
                    yield pd.DataFrame({
                        "doc_id": pd.array(docs["id"], "Int64"), "start": start + starts, "n_tokens": docs["tokens"].astype(np.int64),
                        "ids_crc32": [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)],
                    }).assign(doc_id=lambda f, known=docs["known"].astype(bool): f["doc_id"].where(known))
                    start += len(ids)

    return files.repartition(max(1, n_files), "part").mapInPandas(load, DECODED)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids (50k byte-level vocabulary, end id 2), written in ascending doc_id order and read back."""
    import public_tokenizers

    files, ranked, width = encode(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    return decode(files, ranked, width, files.count())
