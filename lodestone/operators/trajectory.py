"""Principal graphs and pseudotime: rows are softly assigned to a tree of nodes, which sums over rows move.

The tree has some hundred nodes and is held by the driver; rows are only read in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clusters import _rows, fit_centroids
from .linear import summed


def tree_of(nodes: np.ndarray) -> list[tuple[int, int, float]]:
    """Minimum spanning tree over the nodes' distances."""
    n = len(nodes)
    if n < 2:
        return []
    d = np.sqrt(((nodes[:, None] - nodes[None]) ** 2).sum(2))
    near, dist, left, edges = np.zeros(n, int), d[0].copy(), set(range(1, n)), []
    while left:
        j = min(left, key=lambda k: (dist[k], k))
        edges.append((int(min(j, near[j])), int(max(j, near[j])), float(dist[j])))
        left.discard(j)
        closer = d[j] < dist
        near[closer], dist[closer] = j, d[j][closer]
    return sorted(edges)


def principal_graph(points: DataFrame, nodes: int = 50, *, ident: str = "id", vector: str = "features", gamma: float = 10.0, sigma: float = 0.0, rounds: int = 25, tolerance: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Node places and tree edges. A round: soft assignment, a spanning tree, and (diag + γL) Y = RᵀZ."""
    rows = _rows(points, ident, vector).cache()
    y = fit_centroids(rows, nodes, seed=seed, rounds=100)
    k, d = y.shape
    if not sigma:
        got = summed(rows, 2, lambda x: np.array([((x[:, None] - y[None]) ** 2).sum(2).min(1).sum(), len(x)]), "v")
        sigma = max(got[0] / max(got[1], 1), 1e-12)
    edges, last = tree_of(y), None
    for _ in range(rounds):

        def add(x: np.ndarray, y=y) -> np.ndarray:
            dist = ((x[:, None] - y[None]) ** 2).sum(2)
            low = dist - dist.min(1, keepdims=True)
            r = np.exp(-low / sigma)
            r /= r.sum(1, keepdims=True)
            loss = (r * dist).sum() + sigma * (r * np.log(np.maximum(r, 1e-300))).sum()
            return np.concatenate([(r.T @ x).ravel(), r.sum(0), [loss]])

        flat = summed(rows, k * d + k + 1, add, "v")
        laplacian = np.zeros((k, k))
        for a, b, _ in edges:
            laplacian[[a, b], [a, b]] += 1
            laplacian[[a, b], [b, a]] -= 1
        loss = flat[-1] + gamma / 2 * sum(((y[a] - y[b]) ** 2).sum() for a, b, _ in edges)
        y = np.linalg.solve(np.diag(flat[k * d : -1]) + gamma * laplacian + 1e-9 * np.eye(k), flat[: k * d].reshape(k, d))
        edges = tree_of(y)
        if last is not None and abs(last - loss) <= tolerance * max(abs(last), 1e-12):
            break
        last = loss
    rows.unpersist()
    return y, edges


def tree_distances(n: int, edges: list[tuple[int, int, float]], root: int) -> np.ndarray:
    """Distance along the tree from `root` to each node; infinite where there is no way."""
    out, around = np.full(n, np.inf), {}
    for a, b, w in edges:
        around.setdefault(a, []).append((b, w))
        around.setdefault(b, []).append((a, w))
    out[root], open_ = 0.0, [root]
    while open_:
        a = open_.pop()
        for b, w in around.get(a, []):
            if out[a] + w < out[b]:
                out[b] = out[a] + w
                open_.append(b)
    return out


def pseudotime(points: DataFrame, nodes: np.ndarray, edges: list[tuple[int, int, float]], root: int, *, ident: str = "id", vector: str = "features") -> DataFrame:
    """``id``, ``edge``, ``along`` (0 to 1), ``distance`` (squared), ``time``: each row on its nearest edge, the first on ties."""
    a, b = np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int)
    far = tree_distances(len(nodes), edges, root)
    start, step = nodes[a], nodes[b] - nodes[a]
    length2 = (step**2).sum(1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            t = np.clip(((x[:, None] - start[None]) * step[None]).sum(2) / np.where(length2 > 0, length2, 1), 0, 1)
            d = ((x[:, None] - start[None] - t[..., None] * step[None]) ** 2).sum(2)
            e = d.argmin(1)
            row = np.arange(len(x))
            along, size = t[row, e], np.sqrt(length2[e])
            time = np.minimum(far[a[e]] + along * size, far[b[e]] + (1 - along) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(e, pa.int32()), pa.array(along, pa.float64()), pa.array(d[row, e], pa.float64()), pa.array(time, pa.float64())], ["id", "edge", "along", "distance", "time"])

    return _rows(points, ident, vector).mapInArrow(place, "id long, edge int, along double, distance double, time double")


def lineages(n: int, edges: list[tuple[int, int, float]], root: int) -> list[list[int]]:
    """The ways from `root` to each leaf, in the order of their nodes."""
    around = {k: [] for k in range(n)}
    for a, b, _ in edges:
        around[a].append(b)
        around[b].append(a)
    out, open_ = [], [[root]]
    while open_:
        way = open_.pop()
        on = sorted(x for x in around[way[-1]] if len(way) < 2 or x != way[-2])
        if on:
            open_ += [[*way, x] for x in reversed(on)]
        else:
            out.append(way)
    return out


def smoothed_curve(rows: DataFrame, grid: int = 100, bandwidth: float | None = None) -> DataFrame:
    """``step``, ``time``, ``mean``: a weighted kernel mean of ``v`` over ``time`` (weights ``w``), at `grid` steps.

    Each row adds to the steps within four bandwidths only.
    """
    ends = rows.agg(F.min("time").alias("low"), F.max("time").alias("high")).first()  # one row
    if ends.low is None:
        return rows.sparkSession.createDataFrame([], "step int, time double, mean array<double>")
    width = ends.high - ends.low
    h = bandwidth or max(width / 12, 1e-12)
    gap = width / max(grid - 1, 1) or 1.0
    first = F.greatest(F.ceil((F.col("time") - 4 * h - ends.low) / gap), F.lit(0))
    last = F.least(F.floor((F.col("time") + 4 * h - ends.low) / gap), F.lit(grid - 1))
    met = rows.withColumn("step", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    u = (F.col("time") - (ends.low + F.col("step") * gap)) / h
    met = met.withColumn("k", F.col("w") * F.exp(-0.5 * u * u))
    places = met.select("step", "k", F.posexplode("v").alias("pos", "x")).groupBy("step", "pos").agg((F.sum(F.col("k") * F.col("x")) / F.sum("k")).alias("m"))
    return places.groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda t: t["m"]).alias("mean")).select("step", (F.lit(ends.low) + F.col("step") * gap).alias("time"), "mean")
