"""Sampled and multilevel layouts: schedules, starts, placing, and blobs that stay apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import edges, layout, linear, neighbours


def blobs(spark, sizes=(40, 40, 40), width=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = np.eye(len(sizes), width) * 12
    rows = [(int(100 * g + k), (centres[g] + rng.normal(0, 0.6, width)).tolist()) for g, n in enumerate(sizes) for k in range(n)]
    points = spark.createDataFrame(rows, "id long, features array<double>")
    return points, edges.fuzzy_union(edges.memberships(neighbours.exact(points, 8)))


def apart(found):
    at = {r.node: (r.x, r.y) for r in found.collect()}
    groups = {}
    for node, p in at.items():
        groups.setdefault(node // 100, []).append(p)
    centres = {g: np.mean(p, axis=0) for g, p in groups.items()}
    assert all(np.isfinite(p).all() for p in groups.values())
    own = [g == min(centres, key=lambda c: np.hypot(*(np.array(p) - centres[c]))) for g, ps in groups.items() for p in ps]
    return np.mean(own), at


def test_edges_are_used_by_their_share(spark):
    rows = spark.range(300).select("id", (F.col("id") / 299).alias("share"))
    uses = {}
    for r in range(60):
        for x in rows.filter(layout.used_in(r, "share", 5, "id")).collect():
            uses.setdefault(x.id, []).append(r)
    for x in range(300):
        for upto in (7, 31, 60):
            assert abs(sum(u < upto for u in uses.get(x, [])) - upto * x / 299) < 1
    assert uses[299] == list(range(60)) and 0 not in uses
    assert len({tuple(uses[k]) for k in range(100, 110)}) > 5  # their turns differ


def test_starts(spark):
    found = spark.createDataFrame([(1, [2.0, -4.0, 9.0]), (2, [1.0]), (3, [0.0, 0.0])], "id long, scores array<double>")
    at = {r.node: (r.x, r.y) for r in layout.start_from_scores(found, jitter=0.0).collect()}
    assert at == {1: (5.0, -10.0), 2: (2.5, 0.0), 3: (0.0, 0.0)}
    drawn = layout.start_at_random(spark.range(500).withColumnRenamed("id", "node")).agg(F.min("x"), F.max("x"), F.avg("y")).first()
    assert -10 <= drawn[0] < -9 and 9 < drawn[1] <= 10 and abs(drawn[2]) < 1.5


def test_members_are_placed_between_linked_groups_only(spark):
    points = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0]), (4, [9.0, 9.0])], "id long, features array<double>")
    of = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "node long, label long")
    means = spark.createDataFrame([(10, [0.0, 0.0]), (20, [2.0, 0.0]), (30, [5.0, 5.0])], "label long, mean array<double>")
    links = spark.createDataFrame([(10, 20)], "src long, dst long")
    places = spark.createDataFrame([(10, 0.0, 0.0), (20, 8.0, 4.0), (30, -50.0, 0.0)], "node long, x double, y double")
    at = {r.node: (r.x, r.y) for r in layout.place_members(points, of, means, links, places, nearest=2).collect()}
    # row 1 stands on its group, row 2 halfway, row 3 isn't drawn to a group that its own isn't linked with
    assert set(at) == {1, 2, 3} and at[2] == pytest.approx((4.0, 2.0))
    w = np.exp([0.0, -1.0])
    assert at[1] == pytest.approx((8 * w[1] / w.sum(), 4 * w[1] / w.sum())) and at[3][0] > 0


def test_blobs_stay_apart(spark):
    points, graph = blobs(spark, (20, 20, 20))
    start = layout.start_from_scores(linear.scores(points, 2))
    share, at = apart(layout.sampled_layout(graph, start, rounds=20))
    assert share >= 0.9 and len(at) == 60
    assert layout.sampled_layout(graph.limit(0), start).count() == 60 and layout.sampled_layout(graph, start.limit(0)).count() == 0


def test_levels_keep_blobs_apart(spark):
    points, graph = blobs(spark)
    share, at = apart(layout.multilevel_layout(points, graph, fewest=12, rounds=10, refine=3))
    assert share >= 0.95 and len(at) == 120
