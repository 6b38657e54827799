"""
Near duplicates by SimHash fingerprints, compared bit-sliced.

A text is lower-cased (A-Z), split at white space and cut into three-word shingles. Bit b of its fingerprint is 1 if bit b is
set in over half of the shingles' 64-bit hashes. Fingerprints link at `RADIUS` or fewer differing bits, and linked
documents form components.

Only distinct fingerprints are compared. Of four blocks of 16 bits, two differing bits leave two blocks alike, so
fingerprints meet under six masks of 32 bits. A group of more than `GROUP` fingerprints under one mask is cut again by the same rule
over its free bits (16 bits stay, then 8), which is exact and leaves at most 256 in a group at the last level.

Within a task, bit b of all fingerprints is one long integer (a bit plane). Shifting a plane by s lines up every fingerprint with
the one s places on; the differences of 64 planes run through carry-save counters that tell 0, 1, 2 and more for all pairs at once, and
the rest of the planes is left out when every pair is beyond the radius. A task passes on links that join what it
has not joined yet: fewer than it has fingerprints.

Null and empty texts have fingerprint zero and are linked like any other. Null ids take no part in the smallest id; a component of
null ids has a null id. Equal rows stay separate rows. An empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import common
from riskflow.llm.components import components

WORDS, SEED, RADIUS = 3, 42, 2
#: Fingerprints that one group may have before it is cut by more bits.
GROUP = 4096
#: Fingerprints whose bit planes are compared together.
LANES = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit number."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(WORDS)), strict=False) if len(words) >= WORDS else [words]
    hashes = np.array([xxh64_intdigest(b" ".join(run), SEED) for run in runs], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key_id, key_hash, fp) per row of (doc_id, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.drop(columns="text").assign(fp=[fingerprint(t) for t in frame["text"]])

    return common.row_keys(docs).mapInPandas(run, "key_id long, key_hash long, fp long").select(
        F.expr(f"if(key_id = {-(2**63)}L, null, key_id)").alias("doc_id"), "key_id", "key_hash", "fp"
    )


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def finer(mask: int) -> list[int]:
    """The masks that add two of four blocks of the bits that `mask` leaves free."""
    free = [b for b in range(64) if not mask >> b & 1]
    size = len(free) // 4
    blocks = [sum(1 << b for b in free[k * size : (k + 1) * size]) for k in range(4)]
    return [mask | a | b for a, b in combinations(blocks, 2)]


def _under(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """(mask, part, fp): each fingerprint under the finer masks of the mask that it is under."""
    table = F.create_map(*(F.lit(x) for m, more in masks.items() for x in (_signed(m), [_signed(y) for y in more])))
    spread = rows.select("fp", F.explode(F.element_at(table, F.col("mask"))).alias("mask"))
    return spread.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("part"), "fp")


def _planes(codes: np.ndarray) -> list[int]:
    bits = np.unpackbits(codes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(64)]


def _lanes(value: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(value.to_bytes(-(-n // 8), "little"), np.uint8), count=n, bitorder="little"))


def near(codes: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """
    Positions (i, i + s) of fingerprints within the radius, for one s after the other.

    `left[i]` counts the fingerprints of i's group that follow it.
    """
    n, planes = len(codes), _planes(codes)
    for s in range(1, int(left.max(initial=0)) + 1):
        open_ = int.from_bytes(np.packbits(left >= s, bitorder="little").tobytes(), "little")
        ones = twos = beyond = 0
        for b, plane in enumerate(planes):
            differ = plane ^ plane >> s
            carry = ones & differ
            ones ^= differ
            beyond |= twos & differ
            twos |= carry
            if b & 7 == 7 and not open_ & ~beyond:
                break
        else:
            if found := open_ & ~beyond:
                at = _lanes(found, n)
                yield at, at + s


def spanning(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each fingerprint, the position of a representative of what it is linked with in its group (groups begin at `starts`)."""
    n = len(codes)
    ends = np.append(starts[1:], n)
    left = np.repeat(ends, ends - starts) - 1 - np.arange(n)
    root = np.arange(n)
    for a, b in near(codes, left):
        while (open_ := root[a] != root[b]).any():
            a, b = a[open_], b[open_]
            high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def _linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spanning links of the groups of one task; its rows come sorted by (mask, part)."""

    def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for frame in frames:
            held.append(frame)
            n += len(frame)
            if n >= LANES:
                whole = pd.concat(held)
                key = whole[["mask", "part"]].to_numpy()
                change = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
                cut = change[-1] if len(change) else 0
                if cut:
                    yield whole["fp"].to_numpy()[:cut], np.append(0, change[:-1])
                held, n = [whole[cut:]], len(whole) - cut
        if n:
            whole = pd.concat(held)
            key = whole[["mask", "part"]].to_numpy()
            yield whole["fp"].to_numpy(), np.append(0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1)

    for fps, starts in blocks():
        sizes = np.diff(np.append(starts, len(fps)))
        wide = sizes > 64
        # small groups share their planes, a large one has planes of its own
        parts = [np.flatnonzero(~wide & (sizes > 1))] + [[g] for g in np.flatnonzero(wide)]
        for groups in parts:
            if not len(groups):
                continue
            at = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in groups])
            codes = fps[at]
            root = spanning(codes.view(np.uint64), np.append(0, np.cumsum(sizes[groups])[:-1]))
            joined = np.flatnonzero(root != np.arange(len(root)))
            if len(joined):
                yield pd.DataFrame({"a": codes[joined], "b": codes[root[joined]]})


def links(classes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints `fp` within the radius of each other, directly or through others."""
    spark = classes.sparkSession
    top = finer(0)
    rows = _under(classes.select("fp", F.lit(0).cast("long").alias("mask")), {0: top})
    found, masks = [], top
    for level in range(3):
        large = common.written(rows.groupBy("mask", "part").count().where(F.col("count") > group).select("mask", "part"), "simhash-large")
        last = level == 2 or large.isEmpty()
        kept = rows if last else rows.join(large, ["mask", "part"], "left_anti")
        sorted_ = kept.repartition("mask", "part").sortWithinPartitions("mask", "part", "fp")
        with common.batch_rows(spark, LANES):
            found.append(common.written(sorted_.mapInPandas(_linked, "a long, b long"), "simhash-links"))
        if last:
            break
        table = {m: finer(m) for m in masks}
        rows = common.written(_under(rows.join(large, ["mask", "part"], "left_semi"), table), "simhash-finer")
        masks = sorted({m for more in table.values() for m in more})
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(doc_id, key_id, key_hash, fp, root, component_id) per row of (doc_id, text); `root` is a fingerprint of the component."""
    prints = common.written(fingerprints(docs), "simhash-fp")
    classes = common.written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    roots = components(links(classes, group)).select(F.col("node").alias("fp"), "root")
    rooted = common.written(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    firsts = common.written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "simhash-components")
    named = common.written(rooted.select("fp", "root").join(firsts, "root").select("fp", "root", "component_id"), "simhash-named")
    return prints.join(named, "fp")


def deduplicated(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """The rows of a table with doc_id and text, one of each component: the smallest id, null ids last, and one of equal rows."""
    found = common.written(near_duplicates(docs, group), "simhash-found")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_hash", "key_id")
    kept = found.groupBy("root").agg(F.min(order).alias("first")).select("first.key_id", "first.key_hash")
    rows = common.packed(docs)
    if not found.groupBy("key_id", "key_hash").count().where("count > 1").isEmpty():
        # the first of equal rows is taken in each task before they meet
        equal = Window.partitionBy("key_id", "key_hash").orderBy(F.lit(0))
        rows = rows.withColumn("n", F.row_number().over(equal)).where("n = 1").drop("n")
    return rows.join(kept, ["key_id", "key_hash"], "left_semi").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = near_duplicates(common.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
