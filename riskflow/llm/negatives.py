"""
Hard negatives: for an item and one that belongs with it, the best of other labels that score close below.

A score is an inner product of whole numbers. Candidates get one more coordinate that brings all of them to the same norm, so that of
two the nearer to an anchor has the higher score; that makes a metric, and trees of covering radii hold for inner products. The
first level is one net for all: points of a bounded sample, each farthest from those before it, own the candidates nearest to them.
A cell's covering radius is taken over all its candidates. Cells are cut into shards of some thousands; a task builds the tree of
a shard (every node's children cover it at half its radius or less, or are `BRANCH` points each farthest from those before) and takes the requests
that reach it one after the other. The radius of a node bounds what lies below it from above and below, so the descent takes the best
bound first, leaves out what lies outside all windows or below what is found already, and verifies leaves exactly.

A request first goes to the cells of best bounds, then, with the scores found there, to all others that may hold more. Requests
are equal anchors, once; candidates equal in label and vector are one, with the few smallest ids a result can name. So copies
cost nothing, whatever their number. Candidates move once per search and are never copied.

Rows with null id, label or vector, an empty vector, one of another length than most, or one with null or non-finite components take no part.
If an id is repeated, the least of its (label, vector) stands for it. Equal scores go to the smaller id. Components and scores
beyond 64 bits are cut to their ends. An empty table gives no row. Only vec_id, label and embedding are read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskflow.llm import common

LEAF, BRANCH = 256, 16
#: Candidates of one shard, about; points of the first net; the sample they are taken from; cells a request goes to first.
SHARD, CELLS, SAMPLE, SEEDS = 1 << 13, 1 << 10, 1 << 14, 2
_LOW, _HIGH = -(2**63), 2**63 - 1


def lifted(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """`vectors` with the coordinate that brings their squared norm to `norm2`."""
    vectors = vectors.astype(np.float64)
    return np.column_stack([vectors, np.sqrt(np.maximum(norm2 - (vectors**2).sum(1), 0))])


def net(points: np.ndarray, size: int) -> np.ndarray:
    """Rows of up to `size` points, each the farthest from those before it; distinct points only."""
    chosen, least = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < size and least.max(initial=0) > 0:
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def bounds(anchors: np.ndarray, centres: np.ndarray, radii: np.ndarray, norm2: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest scores [anchor, node] of what lies within `radii` of `centres` (lifted to `norm2`)."""
    both = (anchors**2).sum(1)[:, None] + norm2
    distance = np.sqrt(np.maximum(both - 2 * anchors @ centres[:, :-1].T, 0))
    # rounding is far below this
    slack = 1 + 1e-7 * both
    least, most = (both - (distance + radii) ** 2) / 2 - slack, (both - np.maximum(distance - radii, 0) ** 2) / 2 + slack
    # scores are cut to 64 bits; the largest float below 2^63
    return np.minimum(least, 2.0**63 - 1024), np.maximum(most, -(2.0**63))


class Tree:
    """The tree of one shard. `vectors` are whole numbers [row, component]."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list[int]]):
        self.norm2 = float((vectors.astype(np.float64) ** 2).sum(1).max())
        points = lifted(vectors, self.norm2)
        centres, radii, self.children, self.leaf, order = [], [], [], [], []
        low, high = [], []
        waiting = [(None, 0, np.arange(len(vectors)))]
        while waiting:
            parent, centre, rows = waiting.pop()
            node = len(centres)
            if parent is not None:
                self.children[parent].append(node)
            distance = np.sqrt(((points[rows] - points[centre]) ** 2).sum(1))
            radius = float(distance.max())
            centres.append(points[centre])
            radii.append(radius)
            low.append(labels[rows].min())
            high.append(labels[rows].max())
            self.children.append([])
            if len(rows) <= LEAF or not radius:
                self.leaf.append((len(order), len(order) + len(rows)))
                order.extend(rows.tolist())
                continue
            self.leaf.append(None)
            heads, owner = [centre], np.zeros(len(rows), int)
            while len(heads) < BRANCH and distance.max() > radius / 2:
                heads.append(int(rows[distance.argmax()]))
                other = np.sqrt(((points[rows] - points[heads[-1]]) ** 2).sum(1))
                nearer = other < distance
                owner[nearer] = len(heads) - 1
                distance[nearer] = other[nearer]
            waiting += [(node, head, rows[owner == k]) for k, head in enumerate(heads)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.low, self.high = np.array(low).tolist(), np.array(high).tolist()
        self.largest = int(np.abs(vectors.astype(np.float64)).max()) + 1
        self.whole = vectors[order]
        self.exact = self.whole.astype(np.float64)
        self.labels, self.ids = labels[order], [ids[k] for k in order]
        self.verified = 0

    def scores(self, rows: slice, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products, as floats where these are exact."""
        if self.largest * (int(np.abs(anchor.astype(np.float64)).max(initial=0)) + 1) * len(anchor) < 1 << 53:
            return self.exact[rows] @ anchor.astype(np.float64)
        found = self.whole[rows].astype(object) @ anchor.astype(object)
        return np.array([min(max(x, _LOW), _HIGH) for x in found], object)

    def search(self, anchor: np.ndarray, label: int, same: bool, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
        """Per window (least, largest score) the first k (score, id), by score and then smaller id, of the label or of all others."""
        low, high = (b[0].tolist() for b in bounds(anchor.astype(np.float64)[None], self.centres, self.radii, self.norm2))
        need, found = [w[0] for w in windows], [[] for _ in windows]

        def wanted(node: int) -> bool:
            if (not self.low[node] <= label <= self.high[node]) if same else self.low[node] == label == self.high[node]:
                return False
            return any(high[node] >= n and low[node] <= w[1] for n, w in zip(need, windows, strict=True))

        queue = [(-high[0], 0)]
        while queue:
            best, node = heapq.heappop(queue)
            if -best < min(need):
                break
            if not wanted(node):
                continue
            if self.leaf[node] is None:
                for child in self.children[node]:
                    if wanted(child):
                        heapq.heappush(queue, (-high[child], child))
                continue
            start, stop = self.leaf[node]
            self.verified += stop - start
            score = self.scores(slice(start, stop), anchor)
            right = (self.labels[start:stop] == label) == same
            for j, (_, most) in enumerate(windows):
                for row in np.flatnonzero(right & (score >= need[j]) & (score <= most)).tolist():
                    found[j] += [(-int(score[row]), i) for i in self.ids[start + row]]
                if len(found[j]) >= k:
                    found[j] = sorted(found[j])[:k]
                    if len(found[j]) == k:
                        need[j] = max(need[j], -found[j][-1][0])
        return [[(-score, i) for score, i in sorted(own)[:k]] for own in found]


@dataclass
class Shards:
    """Candidates (shard, ids, label, q) and their cells: pivots lifted to `norm2`, covering radii, least and largest label, shards."""

    candidates: DataFrame
    tasks: int
    norm2: float
    pivots: np.ndarray
    radii: np.ndarray
    low: np.ndarray
    high: np.ndarray
    parts: int

    def route(self, requests: DataFrame, same: bool) -> DataFrame:
        """`requests` (rep, label, q, lows, highs) with `cell` and `turn`, 0 for the cells asked first; cells out of reach are left out."""
        pivots, radii, norm2, low, high = self.pivots, self.radii, self.norm2, self.low, self.high

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                anchors = _matrix(batch.column("q")).astype(np.float64)
                least, most = bounds(anchors, pivots, radii, norm2)
                label = batch.column("label").to_numpy()[:, None]
                ok = ((low <= label) & (label <= high)) if same else ~((low == label) & (high == label))
                bottom = np.array([min(x) for x in batch.column("lows").to_pylist()], np.float64)[:, None]
                top = np.array([max(x) for x in batch.column("highs").to_pylist()], np.float64)[:, None]
                ok &= (most >= bottom) & (least <= top)
                # bounds to order cells by; those out of reach come last
                place = np.argsort(np.argsort(np.where(ok, -most, np.inf), axis=1, kind="stable"), axis=1)
                rows, cells = np.nonzero(ok)
                taken = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cells.astype(np.int32)), pa.array((place[rows, cells] >= SEEDS).astype(np.int32)), pa.array(most[rows, cells])],
                    names=[*batch.schema.names, "cell", "turn", "most"],
                )

        return requests.mapInArrow(routed, "rep long, label long, q array<long>, lows array<long>, highs array<long>, cell int, turn int, most double")

    def ask(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        """(rep, window, vec_id, score): the first k of each shard asked."""
        part = F.explode(F.sequence(F.lit(0), F.lit(self.parts - 1)))
        asked = routed.select("*", part.alias("_part")).select(
            (F.col("cell") * self.parts + F.col("_part")).alias("shard"), F.lit(1).alias("kind"), F.array("rep").alias("ids"), "label", "q", "lows", "highs"
        )
        none = F.lit(None).cast("array<long>")
        held = self.candidates.select("shard", F.lit(0).alias("kind"), "ids", "label", "q", none.alias("lows"), none.alias("highs"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, parts, tree = None, [], None
            for batch in batches:
                numbers, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
                edges = np.flatnonzero(np.diff(numbers * 2 + kinds)) + 1
                for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), len(numbers)], strict=True):
                    if start == stop:
                        continue
                    if numbers[start] != shard:
                        shard, parts, tree = numbers[start], [], None
                    own = batch.slice(start, stop - start)
                    if kinds[start] == 0:
                        parts.append(own)
                        continue
                    if tree is None and parts:
                        whole = pa.Table.from_batches(parts).combine_chunks()
                        tree = Tree(_matrix(whole.column("q").chunk(0)), whole.column("label").to_numpy(), whole.column("ids").to_pylist())
                        parts = []
                    if tree is None:
                        continue
                    out = [
                        (rep[0], w, i, score)
                        for rep, label, q, lows, highs in zip(own.column("ids").to_pylist(), own.column("label").to_pylist(), _matrix(own.column("q")), own.column("lows").to_pylist(), own.column("highs").to_pylist(), strict=True)
                        for w, found in enumerate(tree.search(q, label, same, list(zip(lows, highs, strict=True)), k))
                        for score, i in found
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["rep", "window", "vec_id", "score"]
                    )

        # whole shards per task, its candidates before its requests; the requests alone grow, and are streamed
        dealt = held.unionByName(asked).repartitionById(self.tasks, F.col("shard")).sortWithinPartitions("shard", "kind")
        return dealt.mapInArrow(run, "rep long, window int, vec_id long, score long")

    def first(self, requests: DataFrame, same: bool, k: int) -> DataFrame:
        """
        (rep, window, n, vec_id, score): the first k of each window of `requests` (rep, label, q, lows, highs), by score and smaller id.

        What the cells of best bounds give raises the windows' lower ends for all other cells.
        """
        routed = common.written(self.route(requests, same), "negatives-routes")
        seeds = common.written(_best(self.ask(routed.where("turn = 0"), same, k), k), "negatives-seeds")
        known = seeds.where(F.col("n") == k).groupBy("rep").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
        rest = routed.where("turn = 1").join(known, "rep", "left")
        raised = F.transform("lows", lambda low, w: F.greatest(low, F.coalesce(F.try_element_at("known", w), low)))
        rest = rest.withColumn("lows", F.when(F.col("known").isNull(), F.col("lows")).otherwise(raised)).where(F.col("most") >= F.array_min("lows").cast("double"))
        return _best(self.ask(rest, same, k).unionByName(seeds.drop("n")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("rep", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists of whole numbers."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def sharded(items: DataFrame, k: int) -> Shards | None:
    """The classes of (vec_id, label, q), dealt to shards; None without rows."""
    spark = items.sparkSession
    least = Window.partitionBy("label", "q").orderBy("vec_id")
    classes = items.withColumn("_n", F.row_number().over(least)).where(F.col("_n") <= k)
    classes = common.written(classes.groupBy("label", "q").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "negatives-classes")
    total, norm2 = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("q", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    if not total:
        return None
    wanted = common.tasks_for(spark, total, SHARD)
    learned = np.array(classes.orderBy(F.xxhash64("ids"), "label").limit(SAMPLE).select("q").toPandas()["q"].tolist(), np.int64).astype(np.float64)
    norm2 *= 1 + 1e-12
    points = lifted(learned, norm2)
    pivots = points[net(points, min(CELLS, wanted))]

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = lifted(_matrix(batch.column("q")), norm2)
            distance = (own**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * own @ pivots.T
            cell = distance.argmin(1)
            far = np.sqrt(((own - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=[*batch.schema.names, "cell", "far"])

    placed = common.written(classes.select("ids", "label", "q").mapInArrow(owned, "ids array<long>, label long, q array<long>, cell int, far double"), "negatives-cells")
    # one row per cell, CELLS at most
    seen = {r.cell: r for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).collect()}
    cells = sorted(seen)
    number = F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(cells) for x in (c, k))), F.col("cell")) if len(cells) < len(pivots) else F.col("cell")
    parts = max(1, max(-(-seen[c].n // SHARD) for c in cells))
    # equal classes don't exist, so a hash of one deals a crowded cell evenly
    shard = number * parts + F.pmod(F.xxhash64("ids", "label"), F.lit(parts).cast("long")).cast("int")
    return Shards(
        placed.select(shard.alias("shard"), "ids", "label", "q"), len(cells) * parts, norm2, pivots[cells], np.array([seen[c].far for c in cells]) * (1 + 1e-9) + 1e-9,
        np.array([seen[c].low for c in cells]), np.array([seen[c].high for c in cells]), parts,
    )


NEGATIVES = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mined(items: DataFrame, every: int, positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """
    (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, q): anchors are ids divisible by
    `every`, positives their first rows of the same label, negatives the first of others whose score is `percent` to 100 percent of the positive's.
    """
    spark = items.sparkSession
    one = items.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", F.col("row.label").cast("long").alias("label"), "row.q")
    usage = one.groupBy(F.size("q").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if usage is None:
        return spark.createDataFrame([], NEGATIVES)
    usable = common.written(one.where(F.size("q") == usage.n), "negatives-items")
    # an anchor leaves itself out, so one more than wanted is searched and named
    shards = sharded(usable, max(positives + 1, negatives))
    anchors = usable.where(F.col("vec_id") % every == 0)
    classes = common.written(anchors.groupBy("label", "q").agg(F.min("vec_id").alias("rep")), "negatives-anchors")
    ends = F.array(F.lit(_LOW)), F.array(F.lit(_HIGH))
    near = shards.first(classes.select("rep", "label", "q", ends[0].alias("lows"), ends[1].alias("highs")), True, positives + 1)
    near = common.written(near.select("rep", "vec_id", "score"), "negatives-positives")

    high, low = F.col("score"), F.expr(f"cast(-floor(-(cast(score as decimal(20,0)) * {percent}) / 100) as long)")
    # a positive score below zero has no score between its share and itself
    windows = near.where("score >= 0").select("rep", low.alias("low"), high.alias("high")).distinct()
    windows = windows.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("w"))
    wanted = common.written(classes.join(windows, "rep").select("rep", "label", "q", F.col("w.low").alias("lows"), F.col("w.high").alias("highs")), "negatives-windows")
    far = shards.first(wanted, False, negatives)
    far = far.join(wanted.select("rep", "highs"), "rep").select("rep", F.col("highs")[F.col("window")].alias("score"), F.col("n").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))

    named = anchors.select("vec_id", "label", "q").join(classes, ["label", "q"]).select(F.col("vec_id").alias("anchor_id"), "rep")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    pairs = named.join(near, "rep").where("anchor_id <> vec_id").withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives)
    return pairs.select("anchor_id", "rep", F.col("vec_id").alias("positive_id"), "score").join(far, ["rep", "score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score"
    )


def whole(embeddings: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, q) of the rows that take part; q has the components times `scale`, rounded down."""
    # null at a null component, which makes the whole test null
    fit = F.expr("vec_id is not null and label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    return embeddings.where(fit).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("q")
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, after every 7th has moved to the next label."""
    items = whole(common.read(spark, sf_dir, "embeddings"), 256)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    with common.batch_rows(spark, 4096):
        return common.written(mined(items.withColumn("label", moved), 100), "negatives")


SQL = """
WITH items AS (
    SELECT vec_id, min(struct_pack(label := CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END,
                                   q := list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT))) AS item
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    GROUP BY vec_id),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id, a.item.label = b.item.label AS same,
           list_sum(list_transform(list_zip(a.item.q, b.item.q), lambda p: (p[1] * p[2])::HUGEINT))::BIGINT AS score
    FROM items a JOIN items b ON a.vec_id <> b.vec_id AND len(a.item.q) = len(b.item.q)
    WHERE a.vec_id % 100 = 0),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
