"""
Phrases that occur together more often than their parts would by chance, per language.

All runs of 1 to `longest` words are counted twice. First, tasks add up hashed runs and send one summary of keys and counts to each hash
partition; there, summaries are merged into one of Misra and Gries: what exceeds its capacity is paid for by taking the same
amount off every counter. The capacity is above the partition's mass (its occurrences of runs) divided by the threshold, so
no frequent run can vanish, and a run survives if its counter and all that was taken off reach the threshold. The second pass over
the texts counts the survivors exactly, by their words. Keys that two runs share only add survivors, which the second pass tells apart.

A partition's keys are `KEY_BITS` bits of the hash behind those that number the partition. The number of partitions follows from the
size of the texts, so that a task holds about `CAPACITY` counters. A round of the second pass takes at most about `ROUND` survivors, 8
bytes each, to every executor; more of them take more rounds.

Null texts are empty and count nothing; a null language is `und`. Rows are counted one by one, so null ids and equal rows need no
care: equal rows count twice. Texts are taken whole, some megabytes at a time, cut between pieces. An empty table, or one
without a frequent phrase, gives no row. Only the columns text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import common

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
UNKNOWN_LANG = "und"
KEY_BITS = 32
#: Counters of one partition, about.
CAPACITY = 1 << 19
#: Bytes of text handled at once, and hashed runs added up before they are sent.
CHUNK, HELD = 2 << 20, 2 << 20
#: Phrases with their counts that a task adds up before it hands them on.
PHRASES = 1 << 18
#: Survivors that a round of the second pass looks up.
ROUND = 1 << 22
_LETTER, _BLANK, _BREAK = 0, 1, 2
_KIND = np.full(256, _LETTER, np.uint8)
_KIND[list(b" \t")] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose every bit depends on all bits of `x`."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Words of some texts: codes into `names`, the piece and the language of each."""

    names: pa.Array
    codes: np.ndarray
    pieces: np.ndarray
    langs: np.ndarray
    lang_names: list[str]

    def keys(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, first words, hashes) of the runs of each length that lie in one piece."""
        import xxhash

        hashes = np.array([xxhash.xxh64_intdigest(name, 0) for name in self.names.to_pylist()], np.uint64)[self.codes]
        seeds = np.array([xxhash.xxh64_intdigest(name, 1) for name in self.lang_names], np.uint64)[self.langs]
        at, running = np.arange(len(self.codes)), seeds
        for size in range(1, longest + 1):
            if size > 1:
                inside = at + size - 1 < len(self.codes)
                at, running = at[inside], running[inside]
                inside = self.pieces[at] == self.pieces[at + size - 1]
                at, running = at[inside], running[inside]
            running = _mixed(running * np.uint64(0x9E3779B97F4A7C15) + hashes[at + size - 1])
            yield size, at, running


def words(texts: list[bytes], langs: list[str]) -> Words:
    """The words of texts, A-Z in lower case."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])[:-1]
    kind = _KIND[data]
    letter = kind == _LETTER
    # the place after the last byte is no letter; a text's first byte never goes on a word
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    inner = starts[starts < len(data)]
    begins[inner] = letter[inner]
    first = np.flatnonzero(begins)
    lengths = np.add.reduceat(letter, first, dtype=np.int64) if len(first) else np.zeros(0, np.int64)
    text_of = np.searchsorted(starts, first, "right") - 1
    # both terms only grow, so their sum is equal just where both are
    pieces = np.searchsorted(np.flatnonzero(kind == _BREAK), first) + text_of
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letter]])]).dictionary_encode()
    names = sorted(set(langs))
    number = {name: k for k, name in enumerate(names)}
    lang_of = np.array([number[lang] for lang in langs], np.int32)
    return Words(found.dictionary, found.indices.to_numpy(), pieces, lang_of[text_of], names)


def _slices(text: bytes) -> Iterator[bytes]:
    """A text in parts of some `CHUNK` bytes that end where a piece does; a longer piece stays whole."""
    start = 0
    while len(text) - start > CHUNK:
        breaks = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, CHUNK, start)] == _BREAK)
        if len(breaks):
            stop = start + int(breaks[-1]) + 1
        else:
            rest = _KIND[np.frombuffer(text, np.uint8, offset=start)] == _BREAK
            stop = start + int(rest.argmax()) + 1 if rest.any() else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Words of about `CHUNK` bytes of the texts of (text, lang) at a time."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for part in _slices(text):
                texts.append(part)
                langs.append(lang)
                size += len(part)
                if size >= CHUNK:
                    yield words(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield words(texts, langs)


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


class Summary:
    """
    A mergeable summary of Misra and Gries: keys with counters, at most `capacity` of them.

    A key's true count lies between its counter (0 without one) and `taken` more. `taken` is at most the mass added, divided by
    capacity + 1.
    """

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.capacity, 1 << 16):
            self.settle()

    def settle(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(c for _, c in self.waiting)])
        self.waiting, self.size = [], 0
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        if len(keys) > self.capacity:
            least = np.partition(counts, len(counts) - self.capacity - 1)[len(counts) - self.capacity - 1]
            self.taken += int(least)
            kept = counts > least
            keys, counts = keys[kept], counts[kept] - least
        self.keys, self.counts = keys, counts

    def reaching(self, threshold: int) -> np.ndarray:
        """Keys whose true count may reach the threshold."""
        self.settle()
        return self.keys[self.counts + self.taken >= threshold]


def survivors(texts: DataFrame, min_count: int, longest: int) -> tuple[DataFrame, int]:
    """(key long): every frequent run's key, beside few others, of (text binary, lang); and the bits of a key."""
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    # a word takes two bytes at least
    parts = common.tasks_for(spark, size * longest // 2 // min_count, CAPACITY)
    bits = max(1, (parts - 1).bit_length())
    shift, low = np.uint64(64 - bits - KEY_BITS), np.uint64((1 << KEY_BITS) - 1)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mass, held, waiting = np.zeros(1 << bits, np.int64), [], 0

        def sent() -> pa.RecordBatch:
            keys, counts = _counted(np.concatenate(held) if held else np.zeros(0, np.uint64))
            edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS))
            mass[:] += np.diff(np.concatenate([[0], np.cumsum(counts)])[edges])
            full = np.flatnonzero(np.diff(edges))
            own, counts = (keys & low).astype("<u4"), counts.astype("<u4")
            return pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32)), pa.nulls(len(full), pa.int64()),
                 *(pa.array([x[edges[p] : edges[p + 1]].tobytes() for p in full], pa.binary()) for x in (own, counts))],
                ["part", "mass", "keys", "counts"],
            )

        for chunk in _chunks(batches):
            for _, _, keys in chunk.keys(longest):
                held.append(keys >> shift)
                waiting += len(keys)
            if waiting >= HELD:
                yield sent()
                held, waiting = [], 0
        if held:
            yield sent()
        full = np.flatnonzero(mass)
        yield pa.RecordBatch.from_arrays(
            [pa.array(full.astype(np.int32)), pa.array(mass[full]), pa.nulls(len(full), pa.binary()), pa.nulls(len(full), pa.binary())],
            ["part", "mass", "keys", "counts"],
        )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mass, summary = None, 0, None

        def found() -> pa.RecordBatch:
            keys = summary.reaching(min_count) if summary else np.zeros(0, np.uint64)
            return pa.RecordBatch.from_arrays([pa.array((keys | np.uint64((part or 0) << KEY_BITS)).astype(np.int64))], ["key"])

        for batch in batches:
            for row in range(batch.num_rows):
                own, more, keys, counts = (batch.column(k)[row] for k in range(4))
                if own.as_py() != part:
                    yield found()
                    part, mass, summary = own.as_py(), 0, None
                if more.is_valid:  # the masses of a partition come before its summaries
                    mass += more.as_py()
                    continue
                summary = summary or Summary(mass // min_count + 1)
                summary.add(np.frombuffer(keys.as_buffer(), "<u4").astype(np.uint64), np.frombuffer(counts.as_buffer(), "<u4").astype(np.int64))
        yield found()

    # one summary of a partition is a row, so a batch of rows may hold as much as a task has sent to one place
    sent = texts.mapInArrow(summarise, "part int, mass long, keys binary, counts binary").repartitionById(1 << bits, "part")
    with common.batch_rows(spark, 16):
        merged = sent.sortWithinPartitions("part", F.col("mass").asc_nulls_last()).mapInArrow(merge, "key long")
        return common.written(merged, "phrase-keys"), bits + KEY_BITS


COUNTED = "lang string, size int, phrase string, f long"
_SCHEMA = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("part", pa.int32())])


def _phrases(chunk: Words, size: int, at: np.ndarray, which: np.ndarray, parts_of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of one length at `at`, whose keys are number `which` and in partitions `parts_of`, counted by their words, as runs of one key may differ."""
    names = chunk.names.cast(pa.string())
    while len(at):
        own, first, inverse, counts = np.unique(which, return_index=True, return_inverse=True, return_counts=True)
        model = at[first][inverse]
        same = chunk.langs[at] == chunk.langs[model]
        for k in range(size):
            same &= chunk.codes[at + k] == chunk.codes[model + k]
        if not same.all():
            counts = np.bincount(inverse[same], minlength=len(first))
        parts = [names.take(pa.array(chunk.codes[at[first] + k])) for k in range(size)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.lang_names, pa.string()).take(pa.array(chunk.langs[at[first]])), pa.array(np.full(len(first), size, np.int32)),
             pc.binary_join_element_wise(*parts, " "), pa.array(counts.astype(np.int64)), pa.array(parts_of[own])], schema=_SCHEMA,
        )
        at, which = at[~same], which[~same]


def _together(parts: list[pa.RecordBatch]) -> pa.Table:
    """Counts of equal phrases added up."""
    table = pa.Table.from_batches(parts, _SCHEMA).group_by(["lang", "size", "phrase", "part"], use_threads=False).aggregate([("f", "sum")])
    return table.rename_columns([c.removesuffix("_sum") for c in table.column_names]).select(_SCHEMA.names)


def _exact(texts: DataFrame, keys: np.ndarray, bits: int, longest: int, totals: bool) -> DataFrame:
    """
    How often the runs of some keys occur (COUNTED), each once; with `totals`, also all words as a run of no word.

    Tasks send their counts as one row per hash partition, like the summaries before, and they are added up there.
    """
    shared = texts.sparkSession.sparkContext.broadcast(np.sort(keys))
    shift, behind = np.uint64(64 - bits), np.uint64(KEY_BITS)

    def sent(table: pa.Table) -> pa.RecordBatch:
        table = table.sort_by("part")
        parts = table.column("part").to_numpy()
        edges = np.flatnonzero(np.diff(parts, prepend=-1, append=-1))
        blobs = []
        for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _SCHEMA) as out:
                out.write_table(table.slice(start, stop - start))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(parts[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, waiting, settled = None, [], 0, 0

        def whole() -> list[pa.RecordBatch]:
            return _together(held).drop_columns("part").to_batches() if held else []

        for batch in batches:
            for own, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if own != part:
                    yield from whole()
                    part, held, waiting, settled = own, [], 0, 0
                more = pa.ipc.open_stream(counts.as_buffer()).read_all().to_batches()
                held += more
                waiting += sum(m.num_rows for m in more)
                if waiting > 2 * settled + PHRASES:
                    held = _together(held).to_batches()
                    waiting = settled = sum(m.num_rows for m in held)
        yield from whole()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        # most runs are none of the survivors: a table of bits says so before the search
        width = min(26, max(10, len(known).bit_length() + 4))
        maybe = np.zeros(1 << width, bool)
        mask = np.uint64((1 << width) - 1)
        maybe[known & mask] = True
        parts_of = (known >> behind).astype(np.int32)
        held: list[pa.RecordBatch] = []
        waiting = settled = 0
        for chunk in _chunks(batches):
            if totals:
                sums = np.bincount(chunk.langs, minlength=len(chunk.lang_names))
                full = [k for k, n in enumerate(sums) if n]
                columns = [[chunk.lang_names[k] for k in full], [0] * len(full), [""] * len(full), [int(sums[k]) for k in full], [0] * len(full)]
                held.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA))
            for size, at, own in chunk.keys(longest):
                own = own >> shift
                near = maybe[own & mask]
                at, own = at[near], own[near]
                which = np.searchsorted(known, own)
                hit = which < len(known)
                hit[hit] = known[which[hit]] == own[hit]
                for part in _phrases(chunk, size, at[hit], which[hit], parts_of):
                    held.append(part)
                    waiting += part.num_rows
            if waiting > settled + PHRASES:
                held = _together(held).to_batches()
                waiting = settled = sum(part.num_rows for part in held)
                if settled > 2 * PHRASES:
                    yield sent(pa.Table.from_batches(held, _SCHEMA))
                    held, waiting, settled = [], 0, 0
        if held:
            yield sent(_together(held))

    dealt = texts.mapInArrow(count, "part int, counts binary").repartitionById(1 << (bits - KEY_BITS), F.col("part"))
    return dealt.sortWithinPartitions("part").mapInArrow(add, COUNTED)


def frequent(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, size, phrase, f) of all runs of 1 to `longest` words that occur `min_count` times, and of all words as size 0."""
    spark = docs.sparkSession
    texts = docs.select(F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text"), F.coalesce("lang", F.lit(UNKNOWN_LANG)).alias("lang"))
    keys, bits = survivors(texts, min_count, longest)
    rounds = max(1, -(-keys.count() // ROUND))
    out = None
    for n in range(rounds):
        # hashes are even, so a range of them holds its share
        own = keys.where((F.col("key") >= F.lit((n << bits) // rounds)) & (F.col("key") < F.lit((n + 1 << bits) // rounds)))
        counted = _exact(texts, own.toPandas()["key"].to_numpy(np.int64).astype(np.uint64), bits, longest, n == 0)
        out = counted if out is None else out.unionByName(counted)
    # a phrase has one key, and a key one round, so each is there once
    with common.batch_rows(spark, 16):
        return common.written(out.where((F.col("f") >= min_count) | (F.col("size") == 0)), "phrases")


def scored(counts: DataFrame, cover: int = 100, top: int = TOP) -> DataFrame:
    """
    (lang, rank, phrase, a, l, r, n, score) of what `frequent` gives.

    A candidate goes if a longer one that contains it is at least `cover` percent as frequent. Counts of runs only fall as they grow,
    so it is enough to look at candidates one word longer: whatever is longer still has one of those within it, as frequent at least.
    """
    n = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    runs = counts.where("size > 0").select("lang", "phrase", "f")
    split = F.split("phrase", " ")
    candidates = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), split.alias("w"))
    ends = F.array(F.array_join(F.slice("w", F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice("w", F.lit(2), F.col("size") - 1), " "))
    longer = candidates.where("size > 2").select("lang", "a", F.explode(ends).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").where(f"longer is null or 100 * longer < {cover} * a")
    cuts = kept.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    cuts = cuts.join(runs.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(runs.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    # one row per language, of which there are few
    cuts = cuts.join(F.broadcast(n), "lang")
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("l", "r", "n")}
    # 3 + 16 + 19 digits: a count of a phrase stays below 10^16
    over = F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(15,0)") * big["n"]
    under = big["l"].cast("decimal(18,0)") * big["r"].cast("decimal(18,0)")
    cuts = cuts.withColumn("_over", over).withColumn("_under", under).withColumn("score", F.expr("_over div _under"))
    worst = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = worst.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Per language, the `top` phrases of 2 to `longest` words that occur `min_count` times, by the score of their worst cut."""
    return scored(frequent(docs, min_count, longest), top=top)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return collocations(common.read(spark, sf_dir, "documents"))


def sql(min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> str:
    return f"""
WITH pieces AS (
    SELECT lang, row_number() OVER () AS piece, words FROM (
        SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS words
        FROM documents)
    WHERE len(words) > 0),
totals AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
runs AS (
    SELECT lang, size, words[s : s + size - 1] AS w
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS s
          FROM pieces, (SELECT unnest(range(1, {longest + 1})) AS size) WHERE len(words) >= size)),
counted AS (SELECT lang, size, w, count(*) AS f FROM runs GROUP BY lang, size, w HAVING count(*) >= {min_count}),
inner_runs AS (
    SELECT lang, w[s : s + k - 1] AS w, max(f) AS longer
    FROM (SELECT lang, w, f, size, k, unnest(range(1, size - k + 2)) AS s
          FROM counted, (SELECT unnest(range(2, {longest})) AS k) WHERE k < size)
    GROUP BY ALL),
kept AS (
    SELECT c.lang, c.size, c.w, c.f AS a FROM counted c LEFT JOIN inner_runs i ON i.lang = c.lang AND i.w = c.w
    WHERE c.size > 1 AND (i.longer IS NULL OR 100 * i.longer < 100 * c.f)),
cuts AS (SELECT lang, w, a, k, w[1 : k] AS head, w[k + 1 : size] AS rest FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
marked AS (
    SELECT c.lang, array_to_string(c.w, ' ') AS phrase, c.a, h.f AS l, t.f AS r, n, k,
           ((1000::HUGEINT * c.a * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
    FROM cuts c JOIN counted h ON h.lang = c.lang AND h.w = c.head JOIN counted t ON t.lang = c.lang AND t.w = c.rest JOIN totals o ON o.lang = c.lang),
worst AS (SELECT * FROM marked QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM worst QUALIFY rank <= {top}
"""
