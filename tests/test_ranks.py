"""Ranks of pairs that are neither stored nor sorted, against ranks of the sorted pairs."""

from fractions import Fraction
from math import floor
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.frames import shared_folder
from lodestone.operators import edges, neighbours, ranks


def test_values_as_whole_numbers_keep_their_order():
    x = [float("-inf"), -1.5, -1e-300, 0.0, 1e-300, 1.0, 1.0 + 2**-52, float("inf"), float("nan"), None]
    keys = ranks._keys(pa.array(x)).tolist()
    assert keys == sorted(set(keys))
    assert ranks._keys(pa.array([-0.0, -float("nan")])).tolist() == [keys[3], keys[8]]


@pytest.mark.parametrize("ordered, block", [(1 << 18, 2048), (10, 7)])
def test_union_within_by_rank(spark, monkeypatch, ordered, block):
    """Copies, a null component, a shorter vector, null labels; primary edges within labels, between them, and without one."""
    monkeypatch.setattr(ranks, "ORDERED", ordered)
    monkeypatch.setattr(neighbours, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = [[float(c) for c in v] for v in rng.integers(0, 4, (70, 3))]
    x[9][1], x[20] = None, x[20][:2]
    label = [None if k % 17 == 3 else k % 3 // 2 for k in range(70)]
    points = spark.createDataFrame([(3 * k, v, b) for k, (v, b) in enumerate(zip(x, label, strict=True))], "id long, features array<double>, label int")
    drawn = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 70, (200, 2)).tolist() if a != b})
    primary = [(3 * a, 3 * b, float(rng.integers(0, 9))) for a, b in drawn]

    def order(a, b):
        if None in x[a] or None in x[b]:
            return 2, 0.0
        return (0, float(np.sqrt(((np.array(x[a]) - x[b]) ** 2).sum()))) if len(x[a]) == len(x[b]) == 3 or len(x[a]) == len(x[b]) else (1, 0.0)

    same = sorted((*order(a, b), 3 * a, 3 * b) for a in range(70) for b in range(a + 1, 70) if label[a] is not None and label[a] == label[b])
    assert len(same) > 1000
    rank = {(s, d): (Fraction(k, len(same) - 1), 2) for k, (_, _, s, d) in enumerate(same)}
    for k, (_, s, d) in enumerate(sorted((w, s, d) for s, d, w in primary)):
        r, source = rank.get((s, d), (Fraction(2), 0))
        rank[s, d] = min(r, Fraction(k, len(primary) - 1)), source | 1
    want = {e: (floor(r * 100 + Fraction(1, 2)) / 100, source) for e, (r, source) in rank.items()}
    got = edges.union_within(spark.createDataFrame(primary, "src long, dst long, distance double"), points, "label", 2).withColumn("distance", F.round("distance", 2)).collect()
    assert len(got) == len(want) and {(r.src, r.dst): (r.distance, r.source) for r in got} == want
    assert {s for _, s in want.values()} == {1, 2, 3}


def test_few_or_no_pairs(spark):
    points = lambda labels: spark.createDataFrame([(k, [float(k)], b) for k, b in enumerate(labels)], "id long, features array<double>, label int")
    primary = spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0)], "src long, dst long, distance double")
    of = lambda labels: {(r.src, r.dst): (r.distance, r.source) for r in edges.union_within(primary, points(labels), "label", 6).collect()}
    assert of([1, 2, 3]) == {(0, 1): (1.0, 1), (1, 2): (0.0, 1)}
    assert of([1, 1, 3]) == {(0, 1): (0.0, 3), (1, 2): (0.0, 1)}


def test_pairs_are_not_stored(spark):
    """Of 124,750 pairs, some 16 bytes each, little is written but cells and the pairs at the cuts; all were."""
    points = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(np.random.default_rng(3).normal(size=(500, 4)))], "id long, features array<double>, label int")
    primary = spark.createDataFrame([(0, 1, 2.0), (1, 2, 1.0)], "src long, dst long, distance double")
    written = lambda: {f: f.stat().st_size for f in Path(shared_folder(spark)).rglob("*.parquet")}
    before = written()
    assert edges.union_within(primary, points, "label", 1).count() == 124_750
    assert sum(size for f, size in written().items() if f not in before) < 100_000
