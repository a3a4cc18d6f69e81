"""Principal curves of several lineages at once: smooth ways through the rows, from a root to each leaf of a tree.

A curve starts as the broken line through the nodes of its lineage. In a round, tasks project their rows onto all curves
that they belong to, and add each row to the steps of the curve near its place, with a kernel's weight; these sums, steps ×
width for each curve, are the new curves. Rows of nodes that lie on several lineages have a share in each, and where
lineages have nodes in common their curves are drawn to the mean of them, less and less toward the fork.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import cut_lineage, drop
from ..functions.normalise import doubles
from .linear import summed
from .trajectory import lineages


@dataclass
class Curves:
    """For each lineage its nodes, the points of its curve, and the way along it to each point; and the rounds it took."""

    nodes: np.ndarray
    ways: list[list[int]]
    points: np.ndarray  # lineages × steps × width
    along: np.ndarray  # lineages × steps
    rounds: int = 0


def _resampled(points: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """A broken line at `steps` even steps, and the way to each."""
    length = np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(points, axis=0) ** 2).sum(1)))])
    at = np.linspace(0, length[-1], steps)
    return np.stack([np.interp(at, length, c) for c in points.T], 1), at


def _membership(x: np.ndarray, curves: Curves) -> np.ndarray:
    """A row's share in each lineage: equal ones in those that its nearest node lies on."""
    near = ((x[:, None] - curves.nodes[None]) ** 2).sum(2).argmin(1)
    on = np.zeros((len(curves.nodes), len(curves.ways)))
    for k, way in enumerate(curves.ways):
        on[way, k] = 1
    on[on.sum(1) == 0] = 1  # a node on no lineage belongs to all
    return (on / on.sum(1, keepdims=True))[near]


def project(x: np.ndarray, points: np.ndarray, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The way along a broken line to the point nearest to each row, and the squared distance to it; the first on ties."""
    start, step = points[:-1], np.diff(points, axis=0)
    size = (step * step).sum(1)
    t = np.clip((x @ step.T - (start * step).sum(1)) / np.where(size > 0, size, 1), 0, 1)
    d = (x * x).sum(1)[:, None] - 2 * (x @ start.T + t * (x @ step.T)) + (start * start).sum(1) + 2 * t * (start * step).sum(1) + t * t * size
    k = d.argmin(1)
    row = np.arange(len(x))
    return along[k] + t[row, k] * np.diff(along)[k], np.maximum(d[row, k], 0)


def fit_curves(
    points: DataFrame, nodes: np.ndarray, edges: list[tuple[int, int, float]], root: int, *, steps: int = 100, bandwidth: float | None = None,
    rounds: int = 15, tolerance: float = 1e-3, shrink: float = 1.0, ident: str = "id", vector: str = "features",
) -> Curves:
    """Curves along a tree's lineages from `root` (`trajectory.principal_graph`, `tree_of`).

    `bandwidth` is that of the kernel, along a curve; a twelfth of its length by default. With `shrink` 1 the curves of
    lineages that share nodes meet where they begin, with 0 they are only drawn together by the rows they share. Rounds
    end when no point of a curve moves by more than `tolerance` of its length.
    """
    nodes = np.asarray(nodes, float)
    if len(nodes) < 2 or not 0 <= root < len(nodes) or steps < 2:
        raise ValueError("curves need two nodes, a root among them, and two steps")
    ways = lineages(len(nodes), edges, root)
    start = [_resampled(nodes[way] if len(way) > 1 else np.repeat(nodes[way], 2, 0), steps) for way in ways]
    curves = Curves(nodes, ways, np.stack([p for p, _ in start]), np.stack([a for _, a in start]))
    rows = cut_lineage(points.select(doubles(F.col(vector)).alias("v")).filter("v IS NOT NULL"))
    width = nodes.shape[1]
    for curves.rounds in range(1, rounds + 1):

        def sums(x: np.ndarray, c: Curves = curves) -> np.ndarray:
            share = _membership(x, c)
            out = np.zeros((len(c.ways), steps, width + 1))
            for k in range(len(c.ways)):
                own = share[:, k] > 0
                at, _ = project(x[own], c.points[k], c.along[k])
                h = bandwidth or max(c.along[k][-1] / 12, 1e-12)
                weight = np.exp(-0.5 * ((c.along[k][None] - at[:, None]) / h) ** 2) * share[own, k][:, None]
                out[k] = weight.T @ np.hstack([x[own], np.ones((own.sum(), 1))])
            return out

        flat = summed(rows, len(ways) * steps * (width + 1), sums, "v").reshape(len(ways), steps, width + 1)
        seen = flat[:, :, -1:] > 1e-12
        new = np.where(seen, flat[:, :, :-1] / np.where(seen, flat[:, :, -1:], 1), curves.points)
        new = _drawn_together(new, curves, shrink)
        done = [_resampled(p, steps) for p in new]
        moved = max(float(np.sqrt(((p - old) ** 2).sum(1)).max()) / max(a[-1], 1e-12) for (p, a), old in zip(done, curves.points, strict=True))
        curves.points, curves.along = np.stack([p for p, _ in done]), np.stack([a for _, a in done])
        if moved < tolerance:
            break
    drop(rows)
    return curves


def _drawn_together(points: np.ndarray, curves: Curves, shrink: float) -> np.ndarray:
    """Curves moved toward the mean of those that share their first nodes: all the way at the root, not at all from the fork on."""
    out = points.copy()
    length = [np.concatenate([[0.0], np.cumsum(np.sqrt((np.diff(curves.nodes[way], axis=0) ** 2).sum(1)))]) for way in curves.ways]
    for k, way in enumerate(curves.ways):
        with_ = [j for j, other in enumerate(curves.ways) if j != k and len(other) > 1 and len(way) > 1 and other[:2] == way[:2]]
        for j in with_:
            common = next((n for n, (a, b) in enumerate(zip(way, curves.ways[j], strict=False)) if a != b), min(len(way), len(curves.ways[j]))) - 1
            fork = length[k][common] / max(length[k][-1], 1e-12) * curves.along[k][-1]
            if fork <= 0:
                continue
            pull = shrink * np.clip(1 - curves.along[k] / fork, 0, 1) / (len(with_) + 1)
            there = np.stack([np.interp(curves.along[k], curves.along[j], c) for c in points[j].T], 1)
            out[k] += pull[:, None] * (there - points[k])
    return out


def curve_times(points: DataFrame, curves: Curves, *, ident: str = "id", vector: str = "features") -> DataFrame:
    """``id``, ``times`` and ``shares`` by lineage (null where the row has no share), ``branch``, ``time`` and ``distance``.

    ``branch`` is the nearest curve of those that the row has a share in, the first on ties; ``time`` the way along it,
    ``distance`` the squared distance.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(batch.num_rows, -1)
            if not len(x):
                continue
            share = _membership(x, curves)
            found = [project(x, p, a) for p, a in zip(curves.points, curves.along, strict=True)]
            times, far = np.stack([t for t, _ in found], 1), np.stack([d for _, d in found], 1)
            branch = np.where(share > 0, far, np.inf).argmin(1)
            row = np.arange(len(x))
            lists = [pa.array([[v if s > 0 else None for v, s in zip(a, b, strict=True)] for a, b in zip(m.tolist(), share.tolist(), strict=True)], pa.list_(pa.float64())) for m in (times, share)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(branch, pa.int32()), pa.array(times[row, branch]), pa.array(far[row, branch])], ["id", "times", "shares", "branch", "time", "distance"])

    rows = points.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).filter("v IS NOT NULL")
    return rows.mapInArrow(place, "id long, times array<double>, shares array<double>, branch int, time double, distance double")
