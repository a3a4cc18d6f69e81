"""Archetypes: a few convex combinations of rows, of which all rows are in turn, as nearly as can be, convex combinations.

Two sides alternate. Rows find their weights in tasks, which send only sums: weights times weights, and weights times
rows. From these the driver knows the loss as a function of the archetypes alone, and how it slopes; one more pass finds, for
each archetype, the row that lies farthest down the slope, and the archetype moves toward it as far as the loss falls. So
archetypes never leave the hull of the rows, and the driver holds archetypes × width numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut_lineage, drop
from ..functions.normalise import doubles
from .clusters import anchors, elbow, fit_centroids, simplex_weights
from .linear import summed


@dataclass
class Archetypes:
    """The archetypes (rows) and the loss, Σ‖row − weights · archetypes‖², before each round and at the end."""

    places: np.ndarray
    losses: list[float] = field(default_factory=list)


def on_simplex(x: np.ndarray, corners: np.ndarray, steps: int = 100) -> np.ndarray:
    """Weights of the convex combinations of `corners` nearest to the rows of `x`: projected gradients with momentum.

    Of the steps the best is kept for each row.
    """
    gram, cross = corners @ corners.T, x @ corners.T
    pace = 1 / max(float(np.linalg.eigvalsh(gram)[-1]), 1e-12)
    w = np.zeros_like(cross)
    w[np.arange(len(x)), (np.diag(gram)[None] - 2 * cross).argmin(1)] = 1
    loss = lambda v: np.einsum("nk,nk->n", v, v @ gram - 2 * cross)
    best, best_loss, last, ahead, t = w.copy(), loss(w), w, w, 1.0
    for _ in range(steps):
        w = _projected(ahead - pace * (ahead @ gram - cross))
        now = loss(w)
        better = now < best_loss
        best[better], best_loss[better] = w[better], now[better]
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, last, t = w + (t - 1) / t_next * (w - last), w, t_next
    return best


def _projected(v: np.ndarray) -> np.ndarray:
    """The nearest points of the simplex: what is above a level that leaves a sum of 1."""
    u = -np.sort(-v, axis=1)
    total = np.cumsum(u, axis=1) - 1
    count = np.arange(1, v.shape[1] + 1)
    last = (u - total / count > 0).sum(1) - 1
    return np.maximum(v - (total[np.arange(len(v)), last] / (last + 1))[:, None], 0)


def _lowest(rows: DataFrame, slopes: np.ndarray) -> np.ndarray:
    """For each of the `slopes` the row with the least product, the least in the order of numbers on ties."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = [None] * len(slopes)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), float).reshape(batch.num_rows, -1)
            score = x @ slopes.T
            for k, low in enumerate(score.min(0)):
                found = min((float(low), x[n].tolist()) for n in np.flatnonzero(score[:, k] == low)[:64])
                best[k] = found if best[k] is None else min(best[k], found)
        kept = [(k, *b) for k, b in enumerate(best) if b is not None]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in kept], pa.int32()), pa.array([c[1] for c in kept], pa.float64()), pa.array([c[2] for c in kept], pa.list_(pa.float64()))], ["k", "score", "v"])

    found = rows.select("v").mapInArrow(least, "k int, score double, v array<double>").groupBy("k").agg(F.min(F.struct("score", "v")).alias("b"))
    return np.array([r.b.v for r in sorted(found.collect(), key=lambda r: r.k)], float)


def fit(points: DataFrame, k: int, *, vector: str = "features", ident: str = "id", rounds: int = 30, turns: int = 4, tolerance: float = 1e-4, seed: int = 42, start: np.ndarray | None = None) -> Archetypes:
    """`k` archetypes of the rows (fewer, if there are fewer different rows), started at rows that are far apart.

    In a round rows are weighed once, and archetypes move `turns` times; the loss never rises. Rounds end when it falls by
    less than `tolerance` of itself. Rows with null or non-finite components are left out.
    """
    rows = points.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v"))
    rows = cut_lineage(rows.filter(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))))
    a = fit_centroids(rows, k, seed=seed, rounds=0) if start is None else np.asarray(start, float)
    a = np.unique(a, axis=0) if len(a) else a
    out = Archetypes(a)
    if not a.size:
        drop(rows)
        return out
    k, width = a.shape
    for _ in range(rounds):

        def sums(x: np.ndarray, a=a) -> np.ndarray:
            w = on_simplex(x, a)
            return np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel(), [(x * x).sum()]])

        flat = summed(rows, k * k + k * width + 1, sums, "v")
        s, c, square = flat[: k * k].reshape(k, k), flat[k * k : -1].reshape(k, width), flat[-1]
        loss = lambda m, s=s, c=c, square=square: max(float((m * (s @ m)).sum() - 2 * (m * c).sum() + square), 0.0)
        now = loss(a)
        if out.losses and now > out.losses[-1] * (1 - tolerance):
            if now > out.losses[-1]:
                a = before
            break
        out.losses.append(now)
        before = a.copy()
        for _ in range(turns):
            low = _lowest(rows, s @ a - c)
            for j in range(k):
                d = low[j] - a[j]
                slope, curve = float(d @ (s[j] @ a - c[j])), float(s[j, j] * (d @ d))
                if slope < 0 and curve > 0:
                    a = a.copy()
                    a[j] += min(1.0, -slope / curve) * d
        if loss(a) >= now:
            break
    out.places = a
    out.losses.append(float(summed(rows, 1, lambda x: np.array([((x - on_simplex(x, a) @ a) ** 2).sum()]), "v")[0]))
    if len(out.losses) > 1 and out.losses[-1] > out.losses[-2]:
        out.places, out.losses = before, out.losses[:-1]
    drop(rows)
    return out


def select(points: DataFrame, ks: list[int], **options) -> tuple[int, Archetypes]:
    """The number of archetypes at the elbow of the loss over `ks`, and those found with it."""
    if not ks:
        raise ValueError("no numbers to choose from")
    fits = [fit(points, k, **options) for k in ks]
    best = elbow(list(ks), [f.losses[-1] if f.losses else 0.0 for f in fits])
    return ks[best], fits[best]


def anchor_topics(points: DataFrame, features: DataFrame, k: int, *, least_rows: int = 0, ident: str = "id", vector: str = "features", steps: int = 200) -> tuple[list[int], np.ndarray, DataFrame]:
    """Ids of the rows of `features` that span the others, their vectors, and ``id``, ``weights``, ``rss`` of `points` among them.

    While more than two anchors are left, the one that is the heaviest for the fewest rows goes if these are fewer than
    `least_rows`, and rows are weighed again.
    """
    ids = anchors(features, k, ident=ident, vector=vector)
    wanted = features.filter(F.col(ident).isin(ids)).select(F.col(ident).alias("id"), doubles(F.col(vector)).alias("v"))  # k rows
    vectors = {r.id: r.v for r in wanted.collect()}
    while True:
        corners = np.array([vectors[i] for i in ids], float)
        weighed = cut_lineage(simplex_weights(points, corners, ident=ident, vector=vector, steps=steps)) if len(ids) else None
        if weighed is None or not least_rows or len(ids) <= 2:
            return ids, corners, weighed
        first = F.array_position("weights", F.array_max("weights")).cast("int") - 1
        support = {r.k: r["count"] for r in weighed.groupBy(first.alias("k")).count().collect()}
        weak = min(range(len(ids)), key=lambda j: (support.get(j, 0), j))
        if support.get(weak, 0) >= least_rows:
            return ids, corners, weighed
        drop(weighed)
        ids = [i for j, i in enumerate(ids) if j != weak]
