"""Operators that SQL can't express, against plain Python on small tables; and the edges of those that it can."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import frames
from lodestone.functions import normalise, special
from lodestone.operators import clusters, edges, gamma, layout, linear, lookups, neighbours, sampling, stats, trajectory, traverse
from lodestone.sources import sinks, tables
from lodestone.streaming import stats as streams


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>")


def edge_list(spark, pairs, weight=1.0):
    return spark.createDataFrame([(a, b, weight) for a, b in pairs], "src long, dst long, weight double")


def test_gamma_functions(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 100.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.digamma("x").alias("d"), special.trigamma("x").alias("t"), special.lgamma("x").alias("l")).collect()
    h = 1e-5
    for r in got:
        assert r.l == pytest.approx(math.lgamma(r.x))
        assert r.d == pytest.approx((math.lgamma(r.x + h) - math.lgamma(r.x - h)) / (2 * h), rel=1e-4, abs=1e-5)
    assert next(r.t for r in got if r.x == 1.0) == pytest.approx(math.pi**2 / 6)


def test_neighbours_by_cells_are_exact_with_all_cells(spark):
    x = np.random.default_rng(1).normal(size=(300, 6))
    df = points(spark, x)
    a = {(r.id, r.rank): r.other for r in neighbours.exact(df, 5).collect()}
    b = {(r.id, r.rank): r.other for r in neighbours.by_cells(df, 5, cells=9, probes=9).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert a == b == {(i, k + 1): int(j) for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:5])}
    few = {(r.id, r.other) for r in neighbours.by_cells(df, 5, cells=9, probes=4).collect()}
    assert len(few & {(i, j) for (i, _), j in a.items()}) >= 0.9 * len(a)


def test_cells_reach_most_neighbours_of_data_without_clusters(spark):
    x = np.random.default_rng(4).normal(size=(2500, 32))
    df = points(spark, x)
    true = {(r.id, r.other) for r in neighbours.exact(df, 10).collect()}
    assert len({(r.id, r.other) for r in neighbours.by_cells(df, 10).collect()} & true) >= 0.9 * len(true)


def test_ties_go_to_the_smaller_id_and_bad_rows_come_last(spark):
    df = points(spark, [[0, 0], [0, 0], [0, 0], [5, 5], [float("nan"), 0]])
    got = [(r.rank, r.other) for r in neighbours.exact(df, 4).filter("id = 1").orderBy("rank").collect()]
    assert got == [(1, 0), (2, 2), (3, 3), (4, 4)]


def test_memberships_add_up(spark):
    df = points(spark, np.random.default_rng(2).normal(size=(60, 3)))
    sums = edges.memberships(neighbours.exact(df, 5)).groupBy("id").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r.s - math.log2(6)) < 0.05 for r in sums)


def test_edge_folding(spark):
    lists = spark.createDataFrame([(0, 1, 0.5), (1, 0, 0.5), (0, 2, 1.5), (2, 0, 2.0), (2, 3, 0.2), (3, 2, 0.3), (4, 0, 9.0)], "id long, other long, distance double")
    both = {(r.src, r.dst): r.distance for r in edges.from_neighbours(lists, reciprocal=True).collect()}
    assert both == {(0, 1): 0.5, (0, 2): 1.5, (2, 3): 0.2}
    assert edges.from_neighbours(lists).count() == 4


def test_graph_walks(spark):
    g = edge_list(spark, [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (5, 6), (4, 6)])
    nodes = spark.createDataFrame([(i,) for i in range(8)], "node long")
    assert sorted((r.node, r.component) for r in traverse.connected_components(g, nodes).collect()) == [(i, 0) for i in range(7)] + [(7, 1)]
    assert {r.node: r.depth for r in traverse.depths(g, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 4}
    assert sorted((r.src, r.dst) for r in traverse.core(g, 2).collect()) == [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]
    first = {r.node for r in traverse.personal_ranks(g, 2).filter("source = 0").collect()}
    assert first == {1, 2}


def test_spanning_tree_is_minimal(spark):
    rng = np.random.default_rng(3)
    pairs = [(a, b, float(rng.random())) for a in range(12) for b in range(a + 1, 12)]
    got = traverse.spanning_tree(spark.createDataFrame(pairs, "src long, dst long, weight double")).collect()
    root, total = list(range(12)), 0.0

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b, w in sorted(pairs, key=lambda e: e[2]):
        if find(a) != find(b):
            root[find(a)] = find(b)
            total += w
    assert len(got) == 11 and sum(r.weight for r in got) == pytest.approx(total)


def test_communities_of_cliques(spark):
    pairs = [(a + 10 * c, b + 10 * c) for c in range(4) for a in range(8) for b in range(a + 1, 8)] + [(7, 10), (17, 20), (27, 30)]
    nodes = spark.createDataFrame([(a + 10 * c,) for c in range(4) for a in range(8)], "node long")
    labels = {r.node: r.label for r in traverse.communities(edge_list(spark, pairs), nodes, rounds=8, levels=2).collect()}
    assert len(labels) == 32
    assert all(len({labels[10 * c + a] for a in range(8)}) == 1 for c in range(4))


def test_resolution_is_tuned_to_a_number_of_communities(spark):
    pairs = [(a + 10 * c, b + 10 * c) for c in range(4) for a in range(8) for b in range(a + 1, 8)] + [(7, 10), (17, 20), (27, 30)]
    nodes = spark.createDataFrame([(a + 10 * c,) for c in range(4) for a in range(8)], "node long")
    graph = edge_list(spark, pairs)
    alone = traverse.communities(graph, nodes, resolution=2.0, rounds=8, levels=2, objective="cpm")
    assert alone.select("label").distinct().count() == 32  # an edge weighs less than two nodes cost
    labels = {r.node: r.label for r in traverse.tuned_communities(graph, nodes, 4, resolution=2.0, rounds=8, levels=2).collect()}
    assert len(set(labels.values())) == 4 and all(len({labels[10 * c + a] for a in range(8)}) == 1 for c in range(4))
    with pytest.raises(ValueError):
        traverse.communities(graph, nodes, objective="other")


def test_coarsening_reaches_its_target(spark):
    pairs = [(a + 10 * c, b + 10 * c, 1.0) for c in range(4) for a in range(8) for b in range(a + 1, 8)] + [(7, 10, 0.01), (17, 20, 0.01), (27, 30, 0.01)]
    graph = spark.createDataFrame(pairs, "src long, dst long, weight double")
    nodes = spark.createDataFrame([(a + 10 * c,) for c in range(4) for a in range(8)] + [(99,)], "node long")
    for target in (33, 5):
        labels = {r.node: r.label for r in traverse.coarsened(graph, nodes, target).collect()}
        groups = {}
        for node, label in labels.items():
            groups.setdefault(label, []).append(node)
        assert len(labels) == 33 and len(groups) == target and all(label == min(g) for label, g in groups.items())
        assert all(len({node // 10 for node in g}) == 1 for g in groups.values())  # no group spans two cliques
    assert len({r.label for r in traverse.coarsened(graph, nodes, 1).collect()}) == 2  # a piece each
    star = edge_list(spark, [(0, k) for k in range(1, 40)])
    leaves = spark.createDataFrame([(k,) for k in range(40)], "node long")
    sizes = [r["count"] for r in traverse.coarsened(star, leaves, 20).groupBy("label").count().collect()]
    assert sorted(sizes) == [2] * 20  # leaves that wait at the hub pair up in the first round
    assert traverse.coarsened(star.limit(0), leaves, 3).select("label").distinct().count() == 40
    assert traverse.coarsened(star, leaves.limit(0), 3).count() == 0


def test_kmeans_finds_blobs(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(loc=c, scale=0.1, size=(30, 2)) for c in ((0, 0), (5, 5), (0, 5))])
    got = {r.id: r.cluster for r in clusters.kmeans(points(spark, x), 3).collect()}
    assert [len({got[i] for i in range(30 * c, 30 * c + 30)}) for c in range(3)] == [1, 1, 1] and len(set(got.values())) == 3


def test_harmonise_takes_off_a_shift(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(100, 3))
    x[50:] += 2.0
    df = spark.createDataFrame([(i, "a" if i < 50 else "b", x[i].tolist()) for i in range(100)], "id long, batch string, features array<double>")
    z = np.array([r.corrected for r in clusters.harmonise(df, "batch", k=1).orderBy("id").collect()])
    before, after = np.linalg.norm(x[50:].mean(0) - x[:50].mean(0)), np.linalg.norm(z[50:].mean(0) - z[:50].mean(0))
    assert after < 0.1 * before and np.allclose(z.mean(0), x.mean(0), atol=0.05)


def test_svd_and_anchors(spark):
    rng = np.random.default_rng(6)
    x = np.outer(rng.normal(size=80), rng.normal(size=5)) * 3 + rng.normal(size=(80, 5)) * 0.1
    s, v = linear.randomised_svd(points(spark, x), 2)
    assert s == pytest.approx(np.linalg.svd(x)[1][:2], rel=1e-3)
    corners = np.vstack([np.eye(3) * 4, rng.dirichlet([1, 1, 1], 20) * 3])
    found = clusters.anchors(points(spark, corners), 3)
    assert sorted(found) == [0, 1, 2]
    w = clusters.simplex_weights(points(spark, corners), corners[:3]).collect()
    assert all(min(r.weights) >= -1e-9 for r in w)


def test_posterior_draws_have_the_right_mean(spark):
    cells = spark.range(4000).select(F.col("id").alias("row"), F.lit(0).alias("column"))
    params = gamma.prior(cells, 3.0, 2.0)
    got = gamma.sample(params).agg(F.avg("draw").alias("m"), F.var_samp("draw").alias("v")).first()
    assert got.m == pytest.approx(1.5, rel=0.05) and got.v == pytest.approx(0.75, rel=0.15)


def test_array_functions(spark):
    row = spark.createDataFrame([([1.0, 0.8, -3.0], [0.3, -0.2, 9.0], [7.0])], "a array<double>, b array<double>, c array<double>").select(
        normalise.sparsemax(F.col("a")).alias("s"), normalise.stick_breaking(F.col("b")).alias("k"), normalise.stick_breaking(F.col("c")).alias("one")
    ).first()
    assert row.s == pytest.approx([0.6, 0.4, 0.0]) and sum(map(math.exp, row.k)) == pytest.approx(1.0) and row.one == [0.0]


def test_chains(spark):
    rng = np.random.default_rng(7)
    iid, ar = rng.normal(size=2000), np.zeros(2000)
    for k in range(1, 2000):
        ar[k] = 0.9 * ar[k - 1] + rng.normal()
    df = spark.createDataFrame([(c, k, float(v)) for c, x in enumerate((iid, ar, np.ones(2000))) for k, v in enumerate(x)], "chain int, draw int, value double")
    n = {r.chain: r.ess for r in stats.ess(df, ["chain"], ["draw"]).collect()}
    assert n[0] > 1200 and n[1] < 400 and n[2] == 2000


def test_ess_of_chains_that_remember_long(spark):
    """Against sums over whole chains; the slow one goes on over several passes."""
    rng = np.random.default_rng(8)
    slow, noise = np.zeros(1500), rng.normal(size=333)
    for k in range(1, 1500):
        slow[k] = 0.995 * slow[k - 1] + rng.normal()

    def plain(v):
        x, n = v - v.mean(), len(v)
        rho = [(x[: n - k] * x[k:]).sum() / (x * x).sum() for k in range(n)]
        tau, last, k = -1.0, math.inf, 0
        while k < n - 1 and rho[k] + rho[k + 1] > 0:
            last = min(last, rho[k] + rho[k + 1])
            tau, k = tau + 2 * last, k + 2
        return min(n, n / max(tau, 1e-12)), k

    chains = {None: slow, 1: noise, 2: np.array([1.0, 2.0, 1.0]), 3: np.array([5.0])}
    assert plain(slow)[1] > 2 * stats.LAGS
    draws = [(c, k, float(x)) for c, v in chains.items() for k, x in enumerate(v)] + [(1, 999, None)]
    got = {r.chain: (r.n, r.ess) for r in stats.ess(spark.createDataFrame(draws, "chain int, draw int, value double"), ["chain"], ["draw"]).collect()}
    assert got[2] == (3, 3.0) and got[3] == (1, 1.0) and got[None][0] == 1500 and got[1][0] == 333
    assert got[None][1] == pytest.approx(plain(slow)[0]) and got[1][1] == pytest.approx(plain(noise)[0])
    one = spark.createDataFrame([d[1:] for d in draws if d[0] is None], "draw int, value double")
    assert stats.ess(one, [], ["draw"]).first().ess == pytest.approx(plain(slow)[0])
    assert stats.ess(one.limit(0), [], ["draw"]).count() == 0


def test_running_quantile(spark):
    df = spark.range(5000).select(F.lit("a").alias("k"), F.col("id"), ((F.col("id") * 7919) % 10007 / F.lit(10007.0)).alias("x"))
    got = streams.running_quantile_batch(df, "k", ["id"], "x", 0.75).first()
    assert got.n == 5000 and got["quantile"] == pytest.approx(0.75, abs=0.02)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = tmp_path / "in"
    events.write.parquet(str(source))
    stream = streams.windowed_stats(spark.readStream.schema(events.schema).parquet(str(source)), ["event_type"], "ts", "value", "1 day", "1 day")
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "at")).start().awaitTermination(120)
    batch = streams.windowed_stats(events, ["event_type"], "ts", "value", "1 day", "1 day")
    key = lambda r: (r.start, r.event_type, r.nnz, round(r.tot, 6))
    assert sorted(map(key, spark.table("windows").collect())) == sorted(map(key, batch.collect()))


def test_pseudotime_runs_along_a_line(spark):
    rng = np.random.default_rng(8)
    x = np.c_[np.linspace(0, 10, 120), rng.normal(scale=0.05, size=120)]
    nodes, tree = trajectory.principal_graph(points(spark, x), 8, rounds=10, gamma=0.1)
    root = int(nodes[:, 0].argmin())
    time = [r.time for r in trajectory.pseudotime(points(spark, x), nodes, tree, root).orderBy("id").collect()]
    assert np.corrcoef(time, x[:, 0])[0, 1] > 0.99
    assert len(trajectory.lineages(len(nodes), tree, root)) >= 1


def test_diffusion_map_separates_halves(spark):
    pairs = [(a + 10 * c, b + 10 * c) for c in range(2) for a in range(6) for b in range(a + 1, 6)] + [(5, 10)]
    x = {r.node: r.x for r in layout.diffusion_map(edge_list(spark, pairs), rounds=15).collect()}
    assert len({x[a] > 0 for a in range(6)}) == 1 and (x[0] > 0) != (x[15] > 0)


def test_draws_do_not_depend_on_partitions(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    a = sampling.bootstrap(rows.repartition(1), "k").orderBy("k").collect()
    b = sampling.bootstrap(rows.repartition(7), "k").orderBy("k").collect()
    assert a == b and 900 < sum(r.times for r in a) < 1100


def test_tables_round_trip(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("## about\n#chr\tstart\tend\nchr1\t5\t9\n# note\n\nchr2\t\t7\nchr3\n")
    got = sorted(tuple(r) for r in tables.read_table(spark, str(tmp_path / "t.tsv"), ["end", "chr"]).collect())
    assert got == [("", "chr3"), ("7", "chr2"), ("9", "chr1")]
    with pytest.raises(ValueError):
        tables.read_table(spark, str(tmp_path / "t.tsv"), ["nowhere"])
    cells = spark.createDataFrame([(0, 1, 2.5), (3, 0, 1.0), (4, 3, 7.0)], "row long, col long, value double")
    sinks.write_matrix_market(cells, str(tmp_path / "m"), 5, 4)
    shape, back = tables.read_matrix_market(spark, str(tmp_path / "m"))
    assert shape == (5, 4, 3) and sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))
    matrix = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "row string, features array<double>")
    sinks.write_matrix(matrix, str(tmp_path / "d.parquet"))
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "d.parquet")).collect())) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    sinks.write_delimited(matrix, str(tmp_path / "d.txt"))
    assert sorted(map(tuple, tables.read_matrix(spark, str(tmp_path / "d.txt")).collect())) == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]


def test_matching_rules(spark):
    groups = spark.createDataFrame([("ab", "g1", 0), ("abcd", "g2", 1), ("x_1", "g3", 2), ("ab", "g4", 3)], "key string, group string, no int")
    keys = spark.createDataFrame([("ab",), ("ab_7",), ("abz",), ("x_",), ("none",)], "key string")
    got = {r.key: (r.group, r.rule) for r in lookups.match_groups(keys, groups, "_").collect()}
    assert got == {"ab": ("g4", "exact"), "ab_7": ("g4", "base"), "abz": ("g4", "prefix"), "x_": ("g3", "reverse"), "none": (None, "unmatched")}


def test_fdr_of_empty_and_tied(spark):
    df = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, 0.005)], "id long, p double")
    assert [round(r.q, 9) for r in stats.benjamini_hochberg(df).orderBy("id").collect()] == [0.02, 0.04, 0.04, 0.02]
    assert stats.benjamini_hochberg(df.limit(0)).count() == 0


def test_components_of_long_paths(spark, monkeypatch):
    rng = np.random.default_rng(5)
    links = [(k, k + 1) for k in range(400)] + [(1000, 1001), (7, 7)] + [(k, 2000) for k in range(2001, 2300)]
    rng.shuffle(links)
    for held in (1_000_000, 3):
        monkeypatch.setattr(frames, "HELD", held)
        got = frames.components(spark.createDataFrame([(int(a), int(b)) for a, b in links], "a long, b long").repartition(7)).collect()
        assert {r.node: r.root for r in got} == {k: 0 for k in range(1, 401)} | {1001: 1000} | {k: 2000 for k in range(2001, 2300)} and len(got) == 400 + 1 + 299
    assert frames.components(spark.createDataFrame([("b", "a"), ("b", "c")], "a string, b string")).count() == 2
    assert frames.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_orders_in_ranges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 5 == 0 else "hot" if i % 3 else f"k{i % 7}", int(rng.integers(0, 40))) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, key string, x int").repartition(9)
    got = {r.id: r for r in frames.running(df, ["key"], [F.col("x"), F.col("id")], {"total": F.col("x"), "at": F.lit(1)}).collect()}
    want, seen = {}, {}
    for i, key, x in sorted(rows, key=lambda r: (r[2], r[0])):
        t, n = seen.get(key, (0, 0))
        seen[key] = want[i] = (t + x, n + 1)
    assert {i: (r.total, r["at"]) for i, r in got.items()} == want
    ids = frames.numbered(df.select("id"), F.col("id"), "no").collect()
    assert all(r.id == r.no for r in ids) and len(ids) == 2000


def test_background_shares(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", -5.0), ("d", None)], "k string, value double")
    got = {r.k: r.log_share for r in normalise.log_background(df).collect()}
    assert got == pytest.approx({"a": math.log(0.75), "b": math.log(0.25), "c": math.log(1e-3 / 4), "d": math.log(1e-3 / 4)})
    none = normalise.log_background(df.withColumn("value", F.lit(0.0))).collect()
    assert [r.log_share for r in none] == pytest.approx([math.log(0.25)] * 4)
    assert normalise.log_background(df.limit(0)).count() == 0


def test_quantile_of_distances(spark):
    x = np.random.default_rng(5).normal(size=(60, 3))
    far = np.sort([np.linalg.norm(x[i] - x[j]) for i in range(60) for j in range(i + 1, 60)])
    assert neighbours.distance_quantile(points(spark, x), 0.3).first().quantile == pytest.approx(far[int(0.3 * (len(far) - 1))])
    drawn = neighbours.distance_quantile(points(spark, x), 0.5, most_pairs=780).first().quantile
    assert abs(drawn - np.median(far)) < 0.4
    assert neighbours.distance_quantile(points(spark, x[:1]), 0.5).first().quantile is None
