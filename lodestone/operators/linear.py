"""Sums over rows with vectors, and the small matrices that come of them.

The driver holds width × width or width × rank numbers; rows are only ever read, in partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import HELD, matrix
from ..functions.normalise import dot, doubles, log_softmax


def _rows(points: DataFrame, ident: str, vector: str) -> DataFrame:
    return points.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))


def summed(df: DataFrame, width: int, add, column: str) -> np.ndarray:
    """The sum over all batches of the flat array `add(matrix)`: a row a task and place, added up by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += add(np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int64)), pa.array(total)], ["pos", "x"])

    out = np.zeros(width)
    for r in df.select(column).mapInArrow(partial, "pos long, x double").groupBy("pos").agg(F.sum("x").alias("x")).collect():
        out[r.pos] = r.x
    return out


def gram(points: DataFrame, vector: str = "features") -> DataFrame:
    """``i``, ``j``, ``g``: Σ v_i v_j over all rows, i ≤ j, from 0; null vectors are left out, null components count as 0.

    Tasks add up products and give a number a pair of places. Where that is more than `HELD` numbers, the rows are
    read once for each band of places i.
    """
    v = points.select(doubles(F.col(vector)).alias("v")).filter("v is not null")
    first = v.select(F.size("v").alias("n")).first()
    width = max(1, first.n if first else 0)
    step = max(1, HELD // width)

    def band(low: int, high: int | None) -> DataFrame:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((0, 0))
            for batch in batches:
                x, _ = matrix(batch.column(0))
                g = x[:, low:high].T @ x
                if total.shape[1] < g.shape[1]:
                    total, g = g, total
                total[: g.shape[0], : g.shape[1]] += g
            i, j = np.triu_indices(total.shape[0], low, total.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(i + low), pa.array(j), pa.array(total[i, j])], ["i", "j", "x"])

        return v.mapInArrow(partial, "i long, j long, x double")

    lows = range(0, width, step)
    bands = [band(low, low + step if low + step < width else None) for low in lows]
    sums = bands[0]
    for more in bands[1:]:
        sums = sums.unionByName(more)
    return sums.groupBy(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).agg(F.sum("x").alias("g"))


def geometry(points: DataFrame, vector: str = "features") -> DataFrame:
    """One row about the spread of vectors: participation ratios (raw, centred), mean pairwise cosine, largest correlation and variance inflation."""
    spark = points.sparkSession
    rows = points.select(doubles(F.col(vector)).alias("v"))
    first = rows.first()
    names = "n long, participation double, centred_participation double, mean_cosine double, max_correlation double, max_vif double"
    if first is None:
        return spark.createDataFrame([], names)
    d = len(first.v)

    def add(x: np.ndarray) -> np.ndarray:
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return np.concatenate([(x.T @ x).ravel(), x.sum(0), unit.sum(0), [len(x)]])

    flat = summed(rows, d * d + 2 * d + 1, add, "v")
    g, s, u, n = flat[: d * d].reshape(d, d), flat[d * d : d * d + d], flat[d * d + d : -1], flat[-1]
    centred = g - np.outer(s, s) / n
    ratio = lambda m: float(np.trace(m) ** 2 / (m**2).sum()) if (m**2).sum() > 0 else 0.0
    spread = np.sqrt(np.maximum(np.diag(centred), 0))
    corr = centred / np.where(np.outer(spread, spread) > 0, np.outer(spread, spread), 1)
    off = np.abs(corr - np.diag(np.diag(corr))).max() if d > 1 else 0.0
    try:
        vif = max(1.0, float(np.diag(np.linalg.inv(corr)).max()))
    except np.linalg.LinAlgError:
        vif = float("inf")
    mean_cos = float((u @ u - n) / (n * (n - 1))) if n > 1 else 0.0
    return spark.createDataFrame([(int(n), ratio(g), ratio(centred), mean_cos, float(off), vif)], names)


def randomised_svd(points: DataFrame, rank: int, *, ident: str = "id", vector: str = "features", power: int = 5, more: int = 5, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors (width × rank) of the uncentred rows, by subspace iteration.

    Each step is one sum over the rows: XᵀX applied to a thin basis.
    """
    rows = _rows(points, ident, vector)
    first = rows.first()
    if first is None:
        return np.zeros(0), np.zeros((0, 0))
    d = len(first.v)
    thin = min(d, rank + more)
    basis = np.linalg.qr(np.random.default_rng(seed).uniform(-0.5, 0.5, (d, thin)))[0]
    for _ in range(power + 1):
        last = basis
        product = summed(rows, d * thin, lambda x, b=last: x.T @ (x @ b), "v").reshape(d, thin)
        basis = np.linalg.qr(product)[0]
    last = basis
    small = summed(rows, thin * thin, lambda x: (x @ last).T @ (x @ last), "v").reshape(thin, thin)
    values, vectors = np.linalg.eigh(small)
    order = np.argsort(-values)[:rank]
    right = basis @ vectors[:, order]
    right *= np.sign(right[np.abs(right).argmax(0), np.arange(right.shape[1])])
    return np.sqrt(np.maximum(values[order], 0)), right


def scores(points: DataFrame, rank: int, *, skip: int = 0, ident: str = "id", vector: str = "features", seed: int = 42) -> DataFrame:
    """``id``, ``scores``: u·s of the leading components without centring; `skip` leaves out the first ones."""
    _, right = randomised_svd(points, rank + skip, ident=ident, vector=vector, seed=seed)
    turn = right[:, skip:]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ turn).tolist(), pa.list_(pa.float64()))], ["id", "scores"])

    return _rows(points, ident, vector).mapInArrow(project, "id long, scores array<double>")


def top_eigen(matrix: np.ndarray, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading eigenpairs of a small symmetric matrix; each vector's largest entry is positive."""
    values, vectors = np.linalg.eigh(np.asarray(matrix, float))
    order = np.argsort(-values)[:rank]
    vectors = vectors[:, order]
    return values[order], vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])


def knockoff_s(correlation: np.ndarray) -> np.ndarray:
    """The equal variances that knockoffs of a small correlation matrix may have: min(1, 2λ_min)."""
    c = np.asarray(correlation, float)
    return np.full(len(c), min(1.0, max(0.0, 2 * float(np.linalg.eigvalsh(c)[0]))))


def nystrom_place(neighbours: DataFrame, places: DataFrame, alpha: float = 40.0) -> DataFrame:
    """``id``, ``x``, ``y``: rows placed at the mean of their landmarks, weighed by exp(−(d/σ)^α) with σ the largest distance.

    `neighbours` has ``id``, ``other`` (a landmark), ``distance``; `places` has ``other``, ``x``, ``y``.
    """
    from pyspark.sql import Window as W

    sigma = F.max("distance").over(W.partitionBy("id"))
    weighed = neighbours.withColumn("w", F.when(sigma > 0, F.exp(-F.pow(F.col("distance") / sigma, F.lit(alpha)))).otherwise(1.0))
    return weighed.join(places, "other").groupBy("id").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))


def nystrom_basis(points: DataFrame, landmarks: int, *, ident: str = "id", vector: str = "features", seed: int = 42, least: float = 1e-10) -> DataFrame:
    """``id``, ``basis``: coordinates U of the rows X with UUᵀ near XXᵀ, from `landmarks` rows L drawn by a hash of the id.

    U = XLᵀ(LLᵀ)^-½, where directions of LLᵀ with less than `least` of its largest eigenvalue are left out: one pass,
    with landmarks × width numbers in the driver. Exact if the landmarks span the rows. Columns go by falling eigenvalue.
    """
    rows = _rows(points, ident, vector)
    drawn = np.array([r.v for r in rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(landmarks).collect()], float)
    if not drawn.size:
        return rows.select("id", F.array().cast("array<double>").alias("basis")).limit(0)
    values, vectors = top_eigen(drawn @ drawn.T, len(drawn))
    kept = values > least * max(values[0], 1e-300)
    turn = drawn.T @ vectors[:, kept] / np.sqrt(values[kept])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((x @ turn).tolist(), pa.list_(pa.float64()))], ["id", "basis"])

    return rows.mapInArrow(project, "id long, basis array<double>")


def topic_dictionary(features: DataFrame, topics: np.ndarray, ident: str = "id", vector: str = "features") -> DataFrame:
    """``id``, ``topic``, ``value``: log shares of the features in each topic, by the topics' departures from their mean.

    `topics` is a small matrix, a row for each topic; features are normalised over the whole table.
    """
    apart = np.asarray(topics, float) - np.asarray(topics, float).mean(axis=0)
    loads = F.array(*(dot(doubles(F.col(vector)), F.lit(row.tolist())) for row in apart))
    return log_softmax(features.select(F.col(ident).alias("id"), F.posexplode(loads).alias("topic", "value")), "topic")
