"""Nearest neighbours in parts: what meets in a task, ties among copies, and rows that aren't finite."""

import numpy as np
import pytest

from lodestone.operators import cell_index, edges, neighbours


def brute(ids, x, k):
    out = {}
    for a, v in zip(ids, x, strict=True):
        with np.errstate(invalid="ignore"):
            d = np.sqrt(((x - v) ** 2).sum(1))
        d = np.where(np.isfinite(d), d, np.inf)
        out[a] = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != a][:k]
    return out


def lists(found):
    out = {}
    for row in sorted(found.collect(), key=lambda t: (t.id, t.rank)):
        out.setdefault(row.id, []).append(row.other)
    return out


def cloud(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 6)).astype(np.float32).astype(float)
    x[rng.random(n) < 0.4] = x[0]  # more copies than any list holds
    x[3] = np.nan
    return rng.permutation(n), x


@pytest.mark.parametrize("kind", ["float", "double"])
def test_parts_against_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    ids, x = cloud(300)
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], f"id long, features array<{kind}>")
    assert lists(neighbours.exact(points, 4)) == brute(ids, x, 4)
    assert lists(neighbours.by_cells(points, 4, cells=9, probes=9)) == brute(ids, x, 4)


def test_large_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    ids, x = cloud(300, 1)
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, features array<double>")
    assert lists(neighbours.by_cells(points, 3, cells=4, probes=4)) == brute(ids, x, 3)


def test_a_row_is_sent_to_few_parts():
    # a row is sent once for each part of the other side: this grew by one for every 2,048 rows
    for n in (2_000, 120_000, 720_000):
        queries, points = neighbours._shares(n, n, 64, 24)
        assert max(queries, points) <= 6 and queries * points >= min(24, n // neighbours.BLOCK)
        assert n <= neighbours.ROWS * min(queries, points)
    assert neighbours._shares(512, 720_000, 64, 24) == (1, 24)
    assert neighbours._shares(720_000, 3, 64, 24) == (24, 1)


def test_a_search_of_an_index_broadcasts_nothing(spark, tmp_path):
    ids, x = cloud(300, 2)
    points = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "id long, features array<double>")
    cell_index.build(points, str(tmp_path / "i"))
    found = cell_index.search_by_name(spark, str(tmp_path / "i"), points.filter("id % 5 = 0").select("id"), 4, probes=cell_index.MOST_CELLS)
    true = brute(ids, x, 5)
    assert lists(found) == {int(i): [o for o in true[i] if o != ids[3]][:4] for i in ids if i % 5 == 0 and i != ids[3]}
    for visits in ("BroadcastExchange", "BroadcastHashJoin"):
        assert visits not in cell_index.search(spark, str(tmp_path / "i"), points, 4, probes=5)._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_label_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 20)
    ids, x = cloud(120, 4)
    labels = [None if i % 11 == 0 else int(i > 90) for i in ids]
    points = spark.createDataFrame([(int(i), v.tolist(), b) for i, v, b in zip(ids, x, labels, strict=True)] + [(500, None, 1)], "id long, features array<double>, label int")
    of = {int(i): (v, b) for i, v, b in zip(ids, x, labels, strict=True)} | {500: (None, 1)}
    found = neighbours.within(points, "label").collect()
    assert sorted((r.src, r.dst) for r in found) == sorted((a, b) for a in of for b in of if a < b and of[a][1] is not None and of[a][1] == of[b][1])
    for r in found:
        if r.dst == 500:
            assert r.distance is None
        else:
            np.testing.assert_allclose(r.distance, np.sqrt(((of[r.src][0] - of[r.dst][0]) ** 2).sum()), rtol=1e-12)


def test_shared_neighbours_of_a_hub_are_listed_by_its_leaves(spark):
    # hubs with the least ids, as copies' lists make them: each of a hub's edges listed all of its neighbours
    hubs, n = 3, 300
    rows = [(h, k) for h in range(hubs) for k in range(hubs, n)] + [(0, 1), (0, 2), (n, n + 1)]
    graph = spark.createDataFrame(rows, "src long, dst long")
    around = {k: set() for k in range(n + 2)}
    for a, b in rows:
        around[a].add(b)
        around[b].add(a)
    asked = rows + [(3, 4), (1, n), (1, n + 9)]  # a pair without an edge, one without shared neighbours, one with an unknown node
    found = edges.shared_neighbours(graph, spark.createDataFrame(asked, "src long, dst long")).collect()
    assert sorted(map(tuple, found)) == sorted((a, b, len(around[a] & around.get(b, set()))) for a, b in asked)
    turned = edges.by_lesser_degree(graph, graph).collect()
    assert sorted((r.src, r.dst) for r in turned) == sorted(rows) and all({r.less, r.more} == {r.src, r.dst} for r in turned)
    assert sum(len(around[r.less]) for r in turned) <= hubs * n * hubs + 3 * n < sum(len(around[a]) for a, _ in rows)
