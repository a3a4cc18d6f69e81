"""A saved index: recall on 20,000 rows against brute force, and what a search reads."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import cell_index

N, WIDTH, K = 20_000, 16, 10


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (60, WIDTH))[rng.integers(0, 60, N)] * 2 + rng.normal(0, 1, (N, WIDTH))
    x[: N // 3] = x[0] + rng.normal(0, 0.05, (N // 3, WIDTH))  # a hot cell
    path = str(tmp_path_factory.mktemp("index") / "i")
    points = spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())] + [(N, [float("nan")] * WIDTH), (N + 1, None), (None, [0.0] * WIDTH)], "id long, features array<double>")
    cell_index.build(points, path, rounds=3)
    return x, path


def brute(x, queries, own):
    d = ((queries[:, None] - x[None]) ** 2).sum(2)
    if own is not None:
        d[np.arange(len(queries)), own] = np.inf
    return [set(np.argsort(r, kind="stable")[:K].tolist()) for r in d]


def test_recall_by_name(spark, saved):
    x, path = saved
    asked = list(range(0, N, 100))
    found = cell_index.search_by_name(spark, path, spark.createDataFrame([(k,) for k in [*asked, 10**9]], "id long"), K).collect()
    true = dict(zip(asked, brute(x, x[asked], asked), strict=True))
    assert {r.id for r in found} == set(asked) and all(r.other != r.id for r in found)
    assert sum(r.other in true[r.id] for r in found) >= 0.9 * K * len(asked)


def test_a_search_reads_its_cells_only(spark, saved):
    x, path = saved
    one = spark.createDataFrame([(7, x[N - 1].tolist()), (8, None)], "id long, features array<double>")
    found = cell_index.search(spark, path, one, 3, probes=2)
    rows = found.collect()
    assert [r.rank for r in rows] == [1, 2, 3] and rows[0].other == N - 1 and rows[0].distance == 0
    assert re.search(r"PartitionFilters: \[[^\]]*cell#", found._jdf.queryExecution().toString())
    read = cell_index.members(spark, path, [1, 2])
    assert len(read.inputFiles()) and read.select("cell").distinct().count() <= 2
    assert len({f.split("cell=")[1].split("/")[0] for f in read.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}) <= 2


def test_slices_and_all_probes(spark, saved):
    x, path = saved
    cells = spark.read.parquet(f"{path}/centroids")
    assert cells.agg(F.sum("members")).first()[0] == N
    sizes = cell_index.members(spark, path).groupBy("cell", "slice").count().agg(F.max("count")).first()[0]
    assert sizes <= 1.25 * cell_index.BLOCK
    some = x[[5, 11_111]]
    queries = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(some)], "id long, features array<double>")
    found = cell_index.search(spark, path, queries, K, probes=cells.count()).collect()
    assert {(r.id, r.other) for r in found} == {(k, o) for k, s in enumerate(brute(x, some, None)) for o in s}


def test_an_empty_index(spark, tmp_path):
    empty = spark.createDataFrame([], "id long, features array<double>")
    cell_index.build(empty, str(tmp_path / "e"))
    assert cell_index.search(spark, str(tmp_path / "e"), spark.createDataFrame([(1, [0.0])], "id long, features array<double>"), 3).count() == 0
