"""
Removal of byte strings that occur elsewhere, by suffix sorting.

Every byte covered by a `WINDOW`-byte string that also starts at another place, in the same or any other text, is removed.
Texts are UTF-8 bytes; strings are judged on the input.

A suffix per byte would have to carry `WINDOW` bytes each. So each window is tied to one place within it, its anchor: where the hash of
`GRAM` bytes is least, the leftmost of equals. Equal windows have their anchors at equal offsets. Successive windows of one
anchor form a run (185 bytes of new text on average), and only the suffixes that begin at anchors are sorted, each
with the bytes of its run before and after the anchor:

1. Anchors are found in numpy; per run a row (gram hash, digest of the run, place) is written.
2. Runs whose gram occurs once have no repeated window. Equal runs are counted per digest, combined before the shuffle:
   of a run that occurs twice, all windows repeat, and one copy stands for all from here on.
3. Where runs of different content share a gram, their bytes are fetched. Sampled splitters range-partition them by leading
   bytes of the suffix. Equal leads never lie on two sides of a splitter, so no window has its like across a boundary.
4. A bucket sorts its suffixes by multikey quicksort, eight bytes a step, and what precedes the anchors likewise, read backwards. A window with
   `o` bytes before its anchor repeats if another one's suffix shares `WINDOW - o` bytes and its reversed prefix `o`: both
   are ranges of the sorted orders, bounded where neighbours share less.
5. Spans are collected per text and cut out.

A gram that many different runs share (more than `GROUP`) is cut by the bytes common to the windows of each of a few ranges of `o`: nearly the
whole window, so that most runs which differ part company. Equal pieces are counted by content, and one stands for all. Where more than `GROUP`
pieces of different content still have these bytes in common, as at the edges of a passage that many texts share, their windows are
counted one by one by `o` and digest, combined before the shuffle. So no task compares more than `GROUP` pieces of one lead.

Null texts are empty and shorter ones than the window stay whole. Null ids and repeated ids are rows like any other; a
row that repeats another is a second occurrence of its bytes. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import common

WINDOW, GRAM = 400, 64
#: Runs of different content under one gram that one task may compare, and the width of the ranges of `o` beyond that.
GROUP, RANGE = 20_000, 48
#: Bytes of text whose anchors are found at once, and the most a buffer may hold (positions take 24 bits).
SEGMENT, PLACES = 1 << 23, 1 << 24
#: Bytes of runs that are sorted at once.
BUCKET = 1 << 22


def _mixed(n: int) -> np.ndarray:
    """n fixed 64-bit numbers without visible order (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return z ^ z >> np.uint64(31)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each place on; GRAM is a power of two."""
    h, factor, n = _mixed(256)[data], 0x9E3779B97F4A7C15, 1
    while n < GRAM:
        h = h[:-n] * np.uint64(factor) + h[n:]
        factor, n = factor * factor % (1 << 64), 2 * n
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """
    First window, anchor, last window and gram hash of the runs of several texts, laid end to end in `data`.

    Each text has at least WINDOW bytes.
    """
    wide = WINDOW - GRAM + 1
    h = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    packed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(h) // wide) * wide, np.iinfo(np.uint64).max)
    padded[: len(h)] = packed
    blocks = padded.reshape(-1, wide)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    anchor = (np.minimum(behind[: len(data) - WINDOW + 1], ahead[wide - 1 : len(data) - WINDOW + wide]) & low).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int8)
    valid[starts] += 1
    valid[ends - WINDOW + 1] -= 1
    at = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    own = anchor[at]
    change = np.flatnonzero(own[1:] != own[:-1])
    first, last = np.append(0, change + 1), np.append(change, len(at) - 1)
    return at[first], own[first], at[last], h[own[first]].view(np.int64)


RUN = "key_id long, key_hash long, gram long, digest binary, a long, p long, b long"


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    common.release()
    for frame in frames:
        pieces: list[tuple] = []  # (key_id, key_hash, where the piece begins in its text, its bytes)
        size = 0
        for key_id, key_hash, text in zip(frame["key_id"], frame["key_hash"], frame["text"], strict=True):
            raw = (text or "").encode()
            for k in range(0, max(0, len(raw) - WINDOW + 1), SEGMENT):
                piece = raw[k : k + SEGMENT + WINDOW - 1]
                if size + len(piece) > PLACES:
                    yield _rows(pieces)
                    pieces, size = [], 0
                pieces.append((key_id, key_hash, k, piece))
                size += len(piece)
                if size >= SEGMENT:
                    yield _rows(pieces)
                    pieces, size = [], 0
        if pieces:
            yield _rows(pieces)


def _rows(pieces: list[tuple]) -> pd.DataFrame:
    raw = b"".join(x[3] for x in pieces)
    ends = np.cumsum([len(x[3]) for x in pieces])
    starts = np.append(0, ends[:-1])
    a, p, b, gram = runs(np.frombuffer(raw, np.uint8), starts, ends)
    of = np.searchsorted(ends, a, side="right")
    move = np.array([x[2] for x in pieces])[of] - starts[of]
    view = memoryview(raw)
    digest = [hashlib.blake2b(view[x : z + WINDOW], digest_size=16, salt=int(y - x).to_bytes(8, "little")).digest() for x, y, z in zip(a.tolist(), p.tolist(), b.tolist(), strict=True)]
    key_id, key_hash = (np.array([x[k] for x in pieces], np.int64)[of] for k in (0, 1))
    return pd.DataFrame({"key_id": key_id, "key_hash": key_hash, "gram": gram, "digest": digest, "a": a + move, "p": p + move, "b": b + move})


def sort_suffixes(words: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the rows of `words` (big-endian, eight bytes each) within ascending `group`: multikey quicksort."""
    order = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
    todo = [(x, y, 0) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) if y - x > 1]
    depth = words.shape[1]
    while todo:
        x, y, d = todo.pop()
        part = order[x:y]
        key = words[part, d]
        pivot = np.sort(key[[0, len(key) // 2, -1]])[1]
        less, same = key < pivot, key == pivot
        n, m = int(less.sum()), int(same.sum())
        order[x:y] = np.concatenate([part[less], part[same], part[~less & ~same]])
        todo += [t for t in ((x, x + n, d), (x + n, x + n + m, d + 1), (x + n + m, y, d)) if t[1] - t[0] > 1 and t[2] < depth]
    return order


def _shared(sides: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows, and how many bytes each shares with the one before it (-1: another group)."""
    words = np.ascontiguousarray(sides).view(">u8").astype(np.uint64)
    order = sort_suffixes(words, group)
    shared = np.full(len(order), -1)
    for k in range(1, len(order), 4096):
        x, y = order[k - 1 : k + 4095], order[k : k + 4096]
        x = x[: len(y)]
        differ = sides[x] != sides[y]
        same = np.where(differ.any(1), differ.argmax(1), sides.shape[1])
        shared[k : k + 4096] = np.where(group[x] == group[y], same, -1)
    return order, shared


def repeated(texts: list[bytes], at: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray) -> np.ndarray:
    """
    Which windows of each run occur in another run of its group: [run, o] for o bytes before the anchor.

    The anchor of run i is at byte at[i] of its text; its windows have low[i] to high[i] bytes before it.
    """
    m, widest = len(texts), WINDOW - GRAM
    right, left = np.zeros((m, WINDOW), np.uint8), np.zeros((m, -(-widest // 8) * 8), np.uint8)
    for i, (text, k) in enumerate(zip(texts, at.tolist(), strict=True)):
        after, before = np.frombuffer(text, np.uint8, offset=k)[:WINDOW], np.frombuffer(text, np.uint8, count=k)[::-1][:widest]
        right[i, : len(after)], left[i, : len(before)] = after, before
    (r_order, r_shared), (l_order, l_shared) = _shared(right, group), _shared(left, group)
    hit = np.zeros((m, widest + 1), bool)
    r_class, l_class = np.empty(m, np.int64), np.empty(m, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        open_ = np.flatnonzero((low <= o) & (o <= high))
        if len(open_) < 2:
            continue
        r_class[r_order] = np.cumsum(r_shared < WINDOW - o)
        l_class[l_order] = np.cumsum(l_shared < o)
        pair = r_class[open_] * m + l_class[open_]
        ranked = np.argsort(pair, kind="stable")
        equal = pair[ranked][1:] == pair[ranked][:-1]
        hit[open_[ranked[1:][equal]], o] = hit[open_[ranked[:-1][equal]], o] = True
    return hit


PIECE = "lead binary, digest binary, n long, key_id long, key_hash long, start long, at int, low int, high int, bytes binary, content binary"


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of runs, from the texts that hold them; runs of crowded grams in pieces by ranges of o, with a digest of what each holds."""
    columns = [x.split()[0] for x in PIECE.split(", ")]
    seen = set()  # of rows that repeat one another, one gives the pieces
    for frame in frames:
        out = []
        for key_id, key_hash, text, found in zip(frame["key_id"], frame["key_hash"], frame["text"], frame["runs"], strict=True):
            if (key_id, key_hash) in seen:
                continue
            seen.add((key_id, key_hash))
            raw = text.encode()
            for run in found:
                a, p, b, crowded = run["a"], run["p"], run["b"], run["crowded"]
                low, high = p - b, p - a
                cuts = [(low, high)] if not crowded else [(max(low, k), min(high, k + RANGE - 1)) for k in range(low // RANGE * RANGE, high + 1, RANGE)]
                for x, y in cuts:
                    lead, content, held = raw[p : p + GRAM], None, raw[p - y : p - x + WINDOW]
                    if crowded:
                        k = x // RANGE * RANGE
                        # the bytes that all windows of the range have, here and in any other run
                        lead = k.to_bytes(2, "big") + raw[p - k : p - (k + RANGE - 1) + WINDOW]
                        content = hashlib.blake2b(held, digest_size=16, salt=x.to_bytes(4, "big") + y.to_bytes(4, "big")).digest()
                    out.append((lead, run["digest"], run["n"], key_id, key_hash, p - y, y, x, y, held, content))
        yield pd.DataFrame(out, columns=columns)


SPAN = "key_id long, key_hash long, start long, stop long"
SINGLE = "o int, window binary, key_id long, key_hash long, start long"


def _singles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every window of the pieces by itself: o, its digest, and where it starts."""
    columns = [x.split()[0] for x in SINGLE.split(", ")]
    for frame in frames:
        out = []
        for key_id, key_hash, start, high, raw in zip(frame["key_id"], frame["key_hash"], frame["start"], frame["high"], frame["bytes"], strict=True):
            view = memoryview(raw)
            out += [(high - k, hashlib.blake2b(view[k : k + WINDOW], digest_size=16).digest(), key_id, key_hash, start + k) for k in range(len(raw) - WINDOW + 1)]
        yield pd.DataFrame(out, columns=columns)


def _uncrowded(pieces: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Pieces of crowded grams, one per content and at most `group` per lead, and the spans that are settled without them."""
    pieces = pieces.where("content is not null")
    place = F.struct("key_id", "key_hash", "start")
    contents = pieces.groupBy(F.xxhash64("lead").alias("spot"), "content").agg(F.sum("n").alias("n"), F.min(place).alias("at"))
    contents = common.written(contents, "suffix-piece-contents")
    copied = pieces.join(contents.where("n > 1").select("content"), "content").select("key_id", "key_hash", "start", (F.col("start") + F.col("high") - F.col("low") + WINDOW).alias("stop"))

    large = common.written(contents.groupBy("spot").count().where(F.col("count") > group).select("spot", F.lit(True).alias("large")), "suffix-large")
    one = contents.join(large, "spot", "left").select("content", "n", F.coalesce("large", F.lit(False)).alias("large"), "at.*")
    kept = common.written(pieces.drop("n").join(one, ["content", "key_id", "key_hash", "start"]), "suffix-piece-kept")
    singles = common.written(kept.where("large").mapInPandas(_singles, SINGLE), "suffix-singles")
    again = common.written(singles.groupBy("o", "window").count().where("count > 1").select("o", "window"), "suffix-singles-again")
    alone = singles.join(again, ["o", "window"]).select("key_id", "key_hash", "start", (F.col("start") + WINDOW).alias("stop"))
    return kept.where("not large").select(*pieces.columns), copied.union(alone)


def _compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of windows that repeat, of the pieces of one bucket; whole leads at a time."""
    held, size = [], 0

    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["lead", "digest", "low"], ignore_index=True)
        group = np.append(0, np.cumsum(rows["lead"].to_numpy()[1:] != rows["lead"].to_numpy()[:-1])) if len(rows) else np.zeros(0, int)
        hit = repeated(rows["bytes"].tolist(), rows["at"].to_numpy(), rows["low"].to_numpy(), rows["high"].to_numpy(), group)
        hit[rows["n"].to_numpy() > 1] = False  # all their windows repeat and are reported as such
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (i, x), (_, y) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        anchor = rows["start"].to_numpy()[i] + rows["at"].to_numpy()[i]
        return pd.DataFrame({"key_id": rows["key_id"].to_numpy()[i], "key_hash": rows["key_hash"].to_numpy()[i], "start": anchor - y + 1, "stop": anchor - x + WINDOW})

    for frame in common.batches(frames):
        held.append(frame)
        size += sum(map(len, frame["bytes"]))
        if size >= BUCKET and frame["lead"].iloc[-1] != held[0]["lead"].iloc[0]:
            rows = pd.concat(held, ignore_index=True)
            last = rows["lead"] == rows["lead"].iloc[-1]
            yield settle(rows[~last])
            held = [rows[last]]
            size = sum(map(len, rows["bytes"][last]))
    if held:
        yield settle(pd.concat(held, ignore_index=True))


def repeated_spans(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """(key_id, key_hash, spans): per row key of (doc_id, text) that has any, the repeated byte spans, possibly overlapping."""
    spark = docs.sparkSession
    keyed = common.row_keys(docs).where(F.octet_length("text") >= WINDOW)
    found = common.written(keyed.mapInPandas(_find, RUN), "suffix-runs")
    shared = common.written(found.groupBy("gram").count().where("count > 1").select("gram"), "suffix-grams")
    # grams of many copies are split by the adaptive join: both sides come from tables
    found = common.written(found.join(shared, "gram", "left_semi"), "suffix-candidates")
    place = F.struct("key_id", "key_hash", "a", "p", "b")
    contents = common.written(found.groupBy("gram", "digest").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")), "suffix-contents")
    copies = contents.where("n > 1").select("gram", "digest")
    whole = found.join(copies, ["gram", "digest"]).select("key_id", "key_hash", F.col("a").alias("start"), (F.col("b") + WINDOW).alias("stop"))

    several = common.written(contents.groupBy("gram").count().where("count > 1").withColumn("crowded", F.col("count") > group).select("gram", "crowded"), "suffix-several")
    open_ = contents.join(several, "gram").select("digest", "n", "crowded", "at.*")
    per_text = open_.groupBy("key_id", "key_hash").agg(F.collect_list(F.struct("digest", "n", "crowded", "a", "p", "b")).alias("runs"))
    pieces = common.written(keyed.join(per_text, ["key_id", "key_hash"]).mapInPandas(_pieces, PIECE), "suffix-pieces")
    if not several.where("crowded").isEmpty():
        kept, settled = _uncrowded(pieces, group)
        pieces, whole = pieces.where("content is null").union(kept), whole.union(settled)
    partial = pieces.repartitionByRange("lead").sortWithinPartitions("lead", "digest", "low").mapInPandas(_compare, SPAN)
    partial = common.written(partial, "suffix-spans")
    # a set: rows that repeat one another all give the spans of their text
    return whole.union(partial).groupBy("key_id", "key_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def cut(docs: DataFrame, result: Callable[[bytes, list[tuple[int, int]], bytes], tuple], schema: str, group: int = GROUP) -> DataFrame:
    """Per row: the row as struct `row`, and result(bytes, removed spans, kept bytes) as struct `cut` of type `schema`."""
    joined = common.packed(docs).join(repeated_spans(docs, group), ["key_id", "key_hash"], "left")
    names = [x.split()[0] for x in schema.split(", ")]

    @F.pandas_udf(schema)
    def run(texts: pd.Series, found: pd.Series) -> pd.DataFrame:
        rows = []
        for text, spans in zip(texts, found, strict=True):
            raw = (text or "").encode()
            gone = merged([] if spans is None else list(spans))
            edges = [0, *(x for span in gone for x in span), len(raw)]
            rows.append(result(raw, gone, b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))))
        return pd.DataFrame(rows, columns=names)

    return joined.select("row", run("row.text", "spans").alias("cut"))


def without_repeats(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """
    A table with doc_id and text, its texts without what is repeated, and n_chars, if it has that, counted anew.

    Where a cut leaves part of a character, the part goes too. Null texts stay null.
    """

    def result(raw: bytes, gone: list[tuple[int, int]], kept: bytes) -> tuple:
        return (kept.decode("utf-8", "ignore"),)

    found = cut(docs, result, "text string", group)
    new = {"text": F.expr("if(row.text is null, null, cut.text)"), "n_chars": F.expr("if(row.text is null, row.n_chars, char_length(cut.text))").cast("long") if "n_chars" in docs.columns else None}
    return found.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed from every document, the digest of the rest, and whether it repeats anything at all."""

    def result(raw: bytes, gone: list[tuple[int, int]], kept: bytes) -> tuple:
        return len(raw), len(raw) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), bool(gone)

    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(docs, result, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, repeats boolean").select("row.doc_id", "cut.*")
