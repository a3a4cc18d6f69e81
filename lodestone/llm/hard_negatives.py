"""Hard negatives: for each anchor and each of its positives, the best rows of other labels that aren't too near.

Scores are inner products of integers. Most pairs never get one: vectors are turned by the orthogonal rotation to
the principal axes of all rows, and their products are added up axis by axis, the leading ones first. What is left
out is at most the product of the lengths of the two rests; with a slack for rounding that gives bounds on both sides,
and a pair whose bounds leave no chance is dropped early. What survives is scored in integers, so results are exact.

Anchors, a stated share of the rows, meet all rows in blocks: a task holds a block of anchors with the best rows so
far, and streams the blocks of its slice of the rows, so bounds get tighter as it goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import cut_lineage, drop
from .vectors import integers, matrix, whole

EVERY, POSITIVES, NEGATIVES, SCALE = 100, 5, 10, 256
#: Percent of the positive's score that a negative must have at least, and may have at most.
LEAST, MOST = 30, 90
#: Components count as no more than this: a score of up to 8,192 components is exact in doubles and in longs.
LIMIT = 1 << 20
#: Rows in a block, anchors in a block, rows in a slice, and anchors and rows whose products a task holds at a time.
BLOCK, ANCHORS, SLICE, HELD = 2048, 4096, 1 << 18, 512
#: Share of the axes after which the pairs that are left are looked at again.
STAGES = (0.25, 0.5, 0.75, 0.875)
NOTHING = np.iinfo(np.int64).min


class Turned:
    """Rows turned to the principal axes, with the lengths of what is left of each after each stage."""

    def __init__(self, x: np.ndarray, rotation: np.ndarray):
        self.x, self.y = x, x @ rotation
        width = len(rotation)
        self.cuts = [0, *sorted({max(1, int(width * s)) for s in STAGES if int(width * s) < width})] if width else [0]
        squares = np.cumsum((self.y * self.y)[:, ::-1], axis=1)[:, ::-1]
        self.rest = [np.sqrt(squares[:, c]) if c < width else np.zeros(len(x)) for c in self.cuts]
        self.length = np.sqrt((self.y * self.y).sum(1))
        self.slack = max(1e-10, 64 * width * np.finfo(float).eps)


def bounded(a: Turned, rows_a: slice, b: Turned, live: np.ndarray, low: np.ndarray, high: np.ndarray, chances) -> tuple[np.ndarray, np.ndarray]:
    """Places (anchor, row) of the pairs of `live` whose score may lie in [low, high] of the anchor.

    After the last stage `chances` gets lower and upper bounds of all scores, and may raise `low`.
    """
    partial = np.zeros(live.shape)
    reach = np.outer(a.length[rows_a], b.length)
    for k, start in enumerate(a.cuts[:-1]):
        stop = a.cuts[k + 1]
        partial += a.y[rows_a, start:stop] @ b.y[:, start:stop].T
        rest = np.outer(a.rest[k + 1][rows_a], b.rest[k + 1]) + a.slack * reach
        if k + 2 == len(a.cuts):
            low = np.maximum(low, chances(partial - rest, partial + rest, live))
        live &= (partial + rest >= low[:, None]) & (partial - rest <= high[:, None])
        if not live.any():
            break
    return np.nonzero(live)


def scored(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer inner products of pairs of rows."""
    out = np.empty(len(i), np.int64)
    for s in range(0, len(i), 8192):
        out[s : s + 8192] = np.einsum("ij,ij->i", a[i[s : s + 8192]], b[j[s : s + 8192]])
    return out


class Best:
    """The best rows of each of some lists: higher scores first, ties by the smaller id."""

    def __init__(self, lists: int, k: int):
        self.k = k
        self.scores, self.ids = np.full((lists, k), NOTHING), np.full((lists, k), np.iinfo(np.int64).max)

    def add(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched = np.unique(of)
        if not len(touched):
            return
        old = self.scores[touched].ravel() != NOTHING
        of = np.concatenate([np.repeat(touched, self.k)[old], of])
        ids, scores = np.concatenate([self.ids[touched].ravel()[old], ids]), np.concatenate([self.scores[touched].ravel()[old], scores])
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kept = place < self.k
        self.scores[touched], self.ids[touched] = NOTHING, np.iinfo(np.int64).max
        self.scores[of[kept], place[kept]], self.ids[of[kept], place[kept]] = scores[kept], ids[kept]

    def least(self) -> np.ndarray:
        """The score that a row needs to get into a list, as a number; minus infinity while there is room."""
        return np.where(self.scores[:, -1] == NOTHING, -np.inf, self.scores[:, -1])


def _kth(bounds: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest bound of each row among those that are `sure`; minus infinity if there are fewer."""
    if bounds.shape[1] < k:
        return np.full(len(bounds), -np.inf)
    return np.partition(np.where(sure, bounds, -np.inf), -k, axis=1)[:, -k]


class Nearest:
    """Each anchor's best rows of its own label."""

    out = "anchor_id long, place int, other long, score long"

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, rotation: np.ndarray, k: int):
        self.ids, self.labels, self.rotation, self.turned, self.best = ids, labels, rotation, Turned(x, rotation), Best(len(ids), k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, b: Turned) -> None:
        for s in range(0, len(self.ids), HELD):
            own = slice(s, s + HELD)
            live = (self.labels[own, None] == labels[None]) & (self.ids[own, None] != ids[None])
            low = self.best.least()[own]
            i, j = bounded(self.turned, own, b, live, low, np.full(len(low), np.inf), lambda low_, high_, live_: _kth(low_, live_, self.best.k))
            self.best.add(i + s, ids[j], scored(self.turned.x, b.x, i + s, j))

    def found(self) -> Iterator[tuple[np.ndarray, ...]]:
        i, k = np.nonzero(self.best.scores != NOTHING)
        yield self.ids[i], np.zeros(len(i), np.int32), self.best.ids[i, k], self.best.scores[i, k]


class Windowed:
    """Each anchor's best rows of other labels below each of its positives; `place` is the positive's."""

    out = Nearest.out

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, scores: np.ndarray, rotation: np.ndarray, k: int, least: int, most: int):
        self.ids, self.labels, self.rotation, self.turned, self.places = ids, labels, rotation, Turned(x, rotation), scores.shape[1]
        self.best = Best(len(ids) * self.places, k)
        there = scores != NOTHING
        points = np.where(there, scores, 0)
        self.low, self.high = np.where(there, -(-least * points // 100), np.inf), np.where(there, most * points // 100, -np.inf)

    def meet(self, ids: np.ndarray, labels: np.ndarray, b: Turned) -> None:
        for s in range(0, len(self.ids), HELD):
            own = slice(s, s + HELD)
            low, high = np.maximum(self.low, self.best.least().reshape(-1, self.places))[own], self.high[own]
            full = (low > self.low[own]) | ~(low <= high)

            def chances(low_: np.ndarray, high_: np.ndarray, live_: np.ndarray, low=low, high=high, full=full) -> np.ndarray:
                for p in np.flatnonzero(~full.all(0)):
                    sure = live_ & (low_ >= low[:, p, None]) & (high_ <= high[:, p, None])
                    low[:, p] = np.maximum(low[:, p], _kth(low_, sure, self.best.k))
                return np.where(low <= high, low, np.inf).min(1, initial=np.inf)

            live = self.labels[own, None] != labels[None]
            start = np.where(low <= high, low, np.inf).min(1, initial=np.inf)
            i, j = bounded(self.turned, own, b, live, start, high.max(1, initial=-np.inf), chances)
            points = scored(self.turned.x, b.x, i + s, j)
            for p in range(self.places):
                inside = (points >= low[i, p]) & (points <= high[i, p])
                self.best.add((i[inside] + s) * self.places + p, ids[j[inside]], points[inside])

    def found(self) -> Iterator[tuple[np.ndarray, ...]]:
        i, k = np.nonzero(self.best.scores != NOTHING)
        yield self.ids[i // self.places], (i % self.places).astype(np.int32), self.best.ids[i, k], self.best.scores[i, k]


def principal_axes(blocks: DataFrame, width: int) -> np.ndarray:
    """The orthogonal rotation to the principal axes of all rows, largest first: partial sums of products, by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, "<i4").reshape(-1, width).astype(float)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], ["pos", "x"])

    total = np.zeros(width * width)
    for r in blocks.select("data").mapInArrow(partial, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("x")).collect():
        total[r.pos] = r.x
    return np.linalg.eigh(total.reshape(width, width))[1][:, ::-1] if width else np.zeros((0, 0))


def in_blocks(rows: DataFrame, width: int) -> DataFrame:
    """`rows` (``vec_id``, ``label``, ``x``), up to `BLOCK` to a row: ``ids``, ``labels`` and ``data`` in bytes, written."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, held = [], 0

        def flush() -> pa.RecordBatch:
            ids, labels, data = (np.concatenate(c) for c in zip(*kept, strict=True))
            cells = ([a.tobytes() for a in np.split(c, range(BLOCK, len(c), BLOCK))] for c in (ids, labels, data))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cells], ["ids", "labels", "data"])

        for batch in batches:
            if batch.num_rows:
                kept.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), matrix(batch.column(2), width).astype("<i4")))
                held += batch.num_rows
            if held >= BLOCK:
                yield flush()
                kept, held = [], 0
        if kept:
            yield flush()

    return cut_lineage(rows.select("vec_id", "label", "x").mapInArrow(packed, "ids binary, labels binary, data binary"))


def _against_all(anchors: DataFrame, blocks: DataFrame, groups: int, slices: int, width: int, make) -> DataFrame:
    """What `make(ids, labels, matrix, scores)` has found after each group of anchors has met each slice of the blocks."""
    packed = anchors.groupBy("block").agg(F.collect_list(F.struct("vec_id", "label", "x", "scores")).alias("rows"))  # about ANCHORS rows
    key = F.col("block") * slices + F.col("slice")
    left = packed.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(key.alias("key"), F.lit(0).alias("kind"), "rows", *(F.lit(None).cast("binary").alias(c) for c in ("ids", "labels", "data")))
    right = blocks.withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = right.select(key.alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(packed.schema["rows"].dataType).alias("rows"), "ids", "labels", "data")
    met = left.unionByName(right).repartition(max(1, 2 * groups * slices), "key").sortWithinPartitions("key", "kind")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def found() -> Iterator[pa.RecordBatch]:
            for columns in held.found() if held is not None else ():
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor_id", "place", "other", "score"])

        for batch in batches:
            for n in range(batch.num_rows):
                if batch.column(1)[n].as_py() == 0:
                    yield from found()
                    own = pa.RecordBatch.from_struct_array(batch.column(2)[n].values)
                    held = make(np.asarray(own.column(0)), np.asarray(own.column(1)), matrix(own.column(2), width), matrix(own.column(3), max(map(len, own.column(3)))))
                else:
                    data = np.frombuffer(batch.column(5)[n].as_py(), "<i4").reshape(-1, width) if width else np.zeros((len(batch.column(3)[n].as_py()) // 8, 0))
                    ids, labels = (np.frombuffer(batch.column(c)[n].as_py(), "<i8") for c in (3, 4))
                    held.meet(ids, labels, Turned(data.astype(np.int64), held.rotation))
        yield from found()

    return met.mapInArrow(search, Nearest.out)


def mine(
    points: DataFrame, *, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST,
    scale: int = SCALE, ident: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows whose id is divisible by `every`; an anchor's positives are its first `positives` other rows
    of the same label, and a positive's negatives the first `negatives` rows of other labels whose score is from
    `least` to `most` percent of its own. Components are ⌊scale · x⌋, those beyond ±2^20 count as that. Rows with a
    null id or label, or whose vector is null or has a null or non-finite component, take no part; shorter vectors
    are filled up with zeros. A row that repeats counts as often as it is there, but an anchor once (of several rows
    with its id the one with the least label, then vector), and rows with its own id aren't its partners. A positive
    with a score below 0 has no negatives. Empty tables, or no anchors, give an empty table.
    """
    spark = points.sparkSession
    rows = points.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole("v")).select("vec_id", "label", integers("v", scale, LIMIT).alias("x"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("width"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    if not seen.anchors:
        return spark.createDataFrame([], schema)
    width, groups = seen.width, -(-seen.anchors // ANCHORS)
    # slices of bounded size, and as many more as keep all cores busy
    slices = max(-(-seen.n // SLICE), min(-(-seen.n // BLOCK), -(-2 * spark.sparkContext.defaultParallelism // groups)))
    blocks = in_blocks(rows, width)
    rotation = principal_axes(blocks, width)
    own = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("_r"))
    anchors = cut_lineage(own.select("vec_id", "_r.label", "_r.x", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int").alias("block")))

    def nearest(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, scores: np.ndarray) -> Nearest:
        return Nearest(ids, labels, x, rotation, positives)

    def windowed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, scores: np.ndarray) -> Windowed:
        return Windowed(ids, labels, x, np.where(scores == 0, NOTHING, scores - 1), rotation, negatives, least, most)

    def first(found: DataFrame, by: list[str], k: int) -> DataFrame:
        """The k best of each list over all slices, each of which has sent at most k."""
        return found.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "other"))).filter(F.col("rank") <= k)

    near = cut_lineage(first(_against_all(anchors.withColumn("scores", F.array(F.lit(0).cast("long"))), blocks, groups, slices, width, nearest), ["anchor_id"], positives))
    # a score of 0 or more travels as one more, so that 0 is no positive; those below 0 have no negatives
    points_ = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda t: F.greatest(t["score"] + 1, F.lit(0)))
    of_anchor = near.groupBy("anchor_id").agg(points_.alias("scores")).withColumnRenamed("anchor_id", "vec_id")  # at most `positives` rows
    found = first(_against_all(anchors.join(of_anchor, "vec_id"), blocks, groups, slices, width, windowed), ["anchor_id", "place"], negatives)
    own = near.select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    out = cut_lineage(found.join(own, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")))
    drop(blocks, anchors, near)
    return out
