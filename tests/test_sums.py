"""Sums that tasks hold before they meet: means by label and products of places; tables whose shuffles are released."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.frames import RELEASE, cut_lineage
from lodestone.operators import clusters, linear

VECTORS = [(k, "ab"[k % 2] if k % 5 else None, [float(k % 7), k / 3, -1.0 * k, 2.5]) for k in range(300)]


@pytest.mark.parametrize("held", [1_000_000, 7])
@pytest.mark.parametrize("parts", [1, 6])
def test_gram_and_means(spark, monkeypatch, held, parts):
    monkeypatch.setattr(linear, "HELD", held)
    monkeypatch.setattr(clusters, "HELD", held)
    rows = [*VECTORS, (300, "a", None), (301, "c", [1.0, None, 3.0, None])]
    df = spark.createDataFrame(rows, "id long, label string, v array<double>").repartition(parts)
    x = np.array([[0.0 if c is None else c for c in v] for _, _, v in rows if v])
    got = {(r.i, r.j): r.g for r in linear.gram(df, "v").collect()}
    assert got == {(i, j): pytest.approx((x.T @ x)[i, j]) for i in range(4) for j in range(i, 4)}
    means = {r.label: (r.n, r["mean"]) for r in clusters.means_of(df, "label").collect()}
    labels = [label for _, label, v in rows if v]
    for label in ("a", "b", "c", None):
        mine = x[[other == label for other in labels]]
        assert means.pop(label) == (len(mine), pytest.approx(mine.mean(0).tolist()))
    assert not means


def test_vectors_of_several_widths_and_none(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [2.0, 3.0]), (2, []), (1, [4.0, 5.0, 6.0])], "label int, v array<double>").coalesce(1)
    (row,) = clusters.means_of(df, "label").collect()
    assert (row.label, row.n, row["mean"]) == (1, 3, [7 / 3, 4.0, 6.0])
    assert {(r.i, r.j): r.g for r in linear.gram(df, "v").collect()} == {(0, 0): 21.0, (0, 1): 26.0, (0, 2): 24.0, (1, 1): 34.0, (1, 2): 30.0, (2, 2): 36.0}
    assert clusters.means_of(df.limit(0), "label").count() == 0 and linear.gram(df.limit(0), "v").count() == 0


def test_released_tables_can_be_read_and_the_setting_stays(spark):
    before, df = spark.conf.get(RELEASE), spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count()
    table = cut_lineage(df, release=True)
    assert spark.conf.get(RELEASE) == before
    assert table.agg(F.sum("count")).first()[0] == df.agg(F.sum("count")).first()[0] == 1000
