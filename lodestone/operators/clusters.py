"""k-means, labels, batch correction, archetypes and anchors over rows with vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import HELD, matrix, numbered
from ..functions.normalise import doubles

ROWS = ("id", "v")


def _rows(points: DataFrame, ident: str, vector: str) -> DataFrame:
    return points.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))


def _assigned(rows: DataFrame, centroids: np.ndarray, cosine: bool = False) -> DataFrame:
    """``id``, ``v``, ``cluster``, ``distance`` (squared, or 1 − cosine); ties go to the lower cluster."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            if cosine:
                length = np.linalg.norm(v, axis=1, keepdims=True)
                d = np.where(length > 0, 1 - (v / np.where(length > 0, length, 1)) @ centroids.T, 0.0)
            else:
                d = ((v[:, None, :] - centroids[None, :, :]) ** 2).sum(2) if v.size * len(centroids) < 5e7 else np.stack([((v - c) ** 2).sum(1) for c in centroids], 1)
            best = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.int32()), pa.array(d[np.arange(len(d)), best], pa.float64())], ["id", "v", "cluster", "distance"])

    return rows.mapInArrow(assign, "id long, v array<double>, cluster int, distance double")


def means_of(assigned: DataFrame, by: str = "cluster") -> DataFrame:
    """`by`, ``n`` and ``mean`` of the vectors ``v``: each task adds up its rows by label, and only sums of tasks meet.

    A null label is one of its own, null vectors count for nothing, null components count as 0.
    """
    kind = assigned.schema[by].dataType.simpleString()

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        numbers, of = 0, None

        def sums() -> pa.RecordBatch:
            s, n = zip(*held.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(list(held), of), pa.array(s, pa.list_(pa.float64())), pa.array(n, pa.list_(pa.int64()))], ["_by", "s", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            of = batch.column(0).type
            x, there = matrix(batch.column(1))
            labels = batch.column(0).dictionary_encode(null_encoding="encode")
            codes = labels.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.append(True, np.diff(codes[order]) != 0))
            s, n = np.add.reduceat(x[order], starts), np.add.reduceat(there[order].astype(np.int64), starts)
            for label, a, b in zip(labels.dictionary.take(pa.array(codes[order][starts])).to_pylist(), s, n, strict=True):
                if label in held:
                    c, d = held[label]
                    if len(c) < len(a):
                        (c, a), (d, b) = (a, c), (b, d)
                    c[: len(a)] += a
                    d[: len(b)] += b
                    a, b = c, d
                else:
                    numbers += len(a)
                held[label] = a, b
            if numbers > HELD:
                yield sums()
                held, numbers = {}, 0
        if held:
            yield sums()

    rows = assigned.filter("v is not null").select(F.col(by).alias("_by"), "v").mapInArrow(partial, f"_by {kind}, s array<double>, n array<long>")
    placed = rows.select("_by", F.posexplode(F.arrays_zip("s", "n")).alias("pos", "t")).groupBy("_by", "pos").agg(F.sum("t.s").alias("s"), F.sum("t.n").alias("n")).filter("n > 0")
    means = F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda t: t["m"])
    return placed.groupBy("_by").agg(F.max("n").alias("n"), means.alias("mean")).withColumnRenamed("_by", by)


def fit_centroids(rows: DataFrame, k: int, *, seed: int = 42, rounds: int = 100, cosine: bool = False, most_rows: int | None = None, tolerance: float = 0.0) -> np.ndarray:
    """`k` centroids by seeding far from each other and Lloyd's rounds; `k` × width numbers are all the driver holds.

    `rows` has ``id`` and ``v``. `most_rows` bounds the rows that the fit looks at, chosen by a hash of the id.
    An empty cluster moves to the row that is served worst. Draws are keyed by id, so partitions don't matter.
    """
    if most_rows is not None:
        n = rows.count()
        if n > most_rows:
            rows = rows.filter(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) < F.lit(int((1 << 30) * most_rows / n)))
    rows = rows.filter(F.forall("v", lambda x: ~F.isnan(x))).cache()
    start = rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").select("v").limit(min(k, 64) if k > 64 else 1).collect()
    centroids = np.array([r.v for r in start], float)
    if not len(centroids):
        return np.zeros((0, 0))
    draw = 0
    while len(centroids) < k:
        draw += 1
        # several rows a round, each with a chance that grows with its distance: the largest d² / −ln(u)
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(draw), "id"), F.lit(1 << 40)) + 0.5) / (1 << 40)
        more = min(k - len(centroids), max(1, len(centroids) // 2))
        found = _assigned(rows, centroids, cosine).select("v", (F.col("distance") / -F.log(u)).alias("_w")).orderBy(F.desc("_w")).limit(more).collect()
        if not found:
            break
        centroids = np.vstack([centroids, [r.v for r in found]])
    for _ in range(rounds):
        assigned = _assigned(rows, centroids, cosine)
        got = {r.cluster: np.array(r.mean) for r in means_of(assigned).collect()}
        empty = [c for c in range(len(centroids)) if c not in got]
        if empty:
            worst = assigned.orderBy(F.desc("distance"), "id").select("v").limit(len(empty)).collect()
            got |= {c: np.array(r.v) for c, r in zip(empty, worst, strict=False)}
        new = np.stack([got.get(c, centroids[c]) for c in range(len(centroids))])
        if cosine:
            new = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        moved = np.abs(new - centroids).max()
        centroids = new
        if moved <= tolerance:
            break
    rows.unpersist()
    return centroids


def kmeans(points: DataFrame, k: int, *, ident: str = "id", vector: str = "features", seed: int = 42, rounds: int = 100, cosine: bool = False) -> DataFrame:
    """``id``, ``cluster``, ``distance`` of each row by k-means."""
    rows = _rows(points, ident, vector)
    return _assigned(rows, fit_centroids(rows, k, seed=seed, rounds=rounds, cosine=cosine), cosine).select("id", "cluster", "distance")


def assign(points: DataFrame, centroids: np.ndarray, ident: str = "id", vector: str = "features") -> DataFrame:
    """``id``, ``cluster``, ``distance``: the nearest of given centroids."""
    return _assigned(_rows(points, ident, vector), np.asarray(centroids, float)).select("id", "cluster", "distance")


def compact_labels(labels: DataFrame, ident: str = "id", label: str = "label") -> DataFrame:
    """Labels numbered from 0 by their first appearance in the order of `ident`."""
    firsts = labels.groupBy(label).agg(F.min(ident).alias("_first"))
    places = numbered(firsts, F.col("_first"), "compact")
    return labels.join(places.select(label, F.col("compact").cast("int").alias("compact")), label)


def merge_labels(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """``id``, ``label`` of `fine` (``id``, ``label``) after its labels take those of `coarse` (``id`` is a fine label)."""
    return fine.join(coarse.select(F.col("id").alias("label"), F.col("label").alias("_to")), "label").select("id", F.col("_to").alias("label"))


def harmonise(points: DataFrame, batch: str, *, k: int | None = None, ident: str = "id", vector: str = "features", theta: float = 2.0, sigma: float = 0.1, ridge: float = 1.0, rounds: int = 10, seed: int = 42) -> DataFrame:
    """``id`` and ``corrected``: vectors without the shifts of their batches.

    Soft spherical clusters, with a penalty for clusters that lean to a batch, alternate with a ridge
    regression of the original vectors on the batches in each cluster, whose batch terms are taken off.
    The driver holds sums a cluster and batch; rows stay where they are.
    """
    rows = points.select(F.col(ident).cast("long").alias("id"), F.col(batch).cast("string").alias("b"), doubles(F.col(vector)).alias("z"))
    names = [r.b for r in rows.select("b").distinct().orderBy("b").collect()]  # one row a batch
    share = {r.b: r.n for r in rows.groupBy("b").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    if not total:
        return rows.select("id", F.col("z").alias("corrected"))
    expected = np.array([share[b] / total for b in names])
    k = k or max(1, min(100, round(total / 30)))
    unit = rows.select("id", F.col("z").alias("v"))
    centres = fit_centroids(unit, k, seed=seed, rounds=25, cosine=True)
    width = centres.shape[1]
    shifts = np.zeros((len(centres), len(names), width))
    tilt = np.zeros((len(centres), len(names)))

    def soft(z: np.ndarray, b: np.ndarray) -> np.ndarray:
        length = np.linalg.norm(z, axis=1, keepdims=True)
        score = -2 * (1 - z / np.where(length > 0, length, 1) @ centres.T) / sigma + tilt[:, b].T
        score -= score.max(1, keepdims=True)
        r = np.exp(score)
        return r / r.sum(1, keepdims=True)

    def corrected(z: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
        return z - np.einsum("nk,nkd->nd", r, shifts[:, b].transpose(1, 0, 2))

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        place = {n: i for i, n in enumerate(names)}
        return np.array(batch.column(2).to_pylist(), float).reshape(batch.num_rows, width), np.array([place[x] for x in batch.column(1).to_pylist()], int)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, mass, moved = np.zeros((len(centres), len(names))), np.zeros((len(centres), len(names), width)), np.zeros((len(centres), width))
        for batch in batches:
            z, b = arrays(batch)
            r = soft(corrected(z, b, soft(z, b)) if shifts.any() else z, b)
            new = corrected(z, b, r) if shifts.any() else z
            moved += r.T @ (new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12))
            for j in range(len(names)):
                weight[:, j] += r[b == j].sum(0)
                mass[:, j] += r[b == j].T @ z[b == j]
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([np.concatenate([weight.ravel(), mass.ravel(), moved.ravel()]).tolist()])], ["key", "sums"])

    for _ in range(rounds):
        size = weight_size = len(centres) * len(names)
        added = rows.mapInArrow(sums, "key int, sums array<double>").select(F.posexplode("sums").alias("pos", "x")).groupBy("pos").agg(F.sum("x").alias("x")).collect()
        flat = np.zeros(size * (1 + width) + len(centres) * width)
        for r in added:
            flat[r.pos] = r.x
        weight = flat[:weight_size].reshape(len(centres), len(names))
        mass = flat[weight_size : weight_size * (1 + width)].reshape(len(centres), len(names), width)
        moved = flat[weight_size * (1 + width) :].reshape(len(centres), width)
        before = shifts.copy()
        for c in range(len(centres)):
            # intercept and one term a batch; only the batch terms are shrunk, and taken off
            a = np.zeros((len(names) + 1, len(names) + 1))
            a[0, 0], a[0, 1:], a[1:, 0] = weight[c].sum(), weight[c], weight[c]
            a[np.arange(1, len(a)), np.arange(1, len(a))] = weight[c] + ridge
            right = np.vstack([mass[c].sum(0), mass[c]])
            if np.linalg.cond(a) < 1e12:
                shifts[c] = np.linalg.solve(a, right)[1:]
        observed = weight / np.maximum(weight.sum(1, keepdims=True), 1e-12)
        tilt = theta * np.log(np.maximum(expected[None, :], 1e-12) / np.maximum(observed, 1e-6))
        centres = moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-12)
        if np.abs(shifts - before).max() < 1e-5:
            break

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, b = arrays(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(corrected(z, b, soft(z, b)).tolist(), pa.list_(pa.float64()))], ["id", "corrected"])

    return rows.mapInArrow(finish, "id long, corrected array<double>")


def simplex_weights(points: DataFrame, archetypes: np.ndarray, *, ident: str = "id", vector: str = "features", steps: int = 200) -> DataFrame:
    """``id``, ``weights``, ``rss``: the convex combination of `archetypes` nearest to each row, by Frank–Wolfe."""
    a = np.asarray(archetypes, float)
    gram = a @ a.T

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            cross = x @ a.T
            w = np.zeros((len(x), len(a)))
            w[np.arange(len(x)), (np.diag(gram)[None, :] - 2 * cross).argmin(1)] = 1
            for _ in range(steps):
                slope = w @ gram - cross
                toward = np.zeros_like(w)
                toward[np.arange(len(x)), slope.argmin(1)] = 1
                d = toward - w
                curve = np.einsum("nk,kl,nl->n", d, gram, d)
                step = np.clip(np.where(curve > 0, -(d * slope).sum(1) / np.where(curve > 0, curve, 1), 0), 0, 1)
                w += step[:, None] * d
            rss = ((x - w @ a) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.tolist(), pa.list_(pa.float64())), pa.array(rss, pa.float64())], ["id", "weights", "rss"])

    return _rows(points, ident, vector).mapInArrow(solve, "id long, weights array<double>, rss double")


def anchors(points: DataFrame, k: int, *, ident: str = "id", vector: str = "features") -> list[int]:
    """Ids of `k` rows that span the others: each round takes the row with the largest rest, and projects it off."""
    rows = _rows(points, ident, vector).cache()
    basis, found = np.zeros((0, 0)), []
    for _ in range(k):
        taken = basis

        def rests(batches: Iterator[pa.RecordBatch], taken=taken) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
                if taken.size:
                    x = x - x @ taken.T @ taken
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.tolist(), pa.list_(pa.float64())), pa.array((x * x).sum(1), pa.float64())], ["id", "rest", "size"])

        top = rows.mapInArrow(rests, "id long, rest array<double>, size double").orderBy(F.desc("size"), "id").first()
        if top is None or top["size"] <= 1e-12:
            break
        found.append(top["id"])
        rest = np.array(top["rest"])
        basis = np.vstack([basis.reshape(-1, len(rest)), rest / np.linalg.norm(rest)])
    rows.unpersist()
    return found


def elbow(ks: list[int], losses: list[float]) -> int:
    """Place of the largest distance from the chord of the normalised curve; 0 for fewer than three points."""
    if len(ks) < 3:
        return 0
    x, y = np.array(ks, float), np.array(losses, float)
    x, y = (x - x[0]) / (x[-1] - x[0]), (y - y[-1]) / ((y[0] - y[-1]) or 1)
    return int(np.argmax(np.abs(1 - x - y)))
