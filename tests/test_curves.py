"""Archetypes and principal curves, on planted simplices and forks; and bases from landmarks."""

import numpy as np
import pytest

from lodestone.operators import archetypes, curves, linear


def rows_of(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.asarray(x, float))], "id long, features array<double>").repartition(3)


def simplex(n=300, seed=0):
    rng = np.random.default_rng(seed)
    corners = np.array([[0, 0, 1.0, 0], [8, 0, 0, 0], [0, 9, 0, 2.0]])
    return corners, np.vstack([rng.dirichlet([0.6] * 3, n) @ corners, corners])


def test_archetypes_find_the_corners(spark):
    corners, x = simplex()
    found = archetypes.fit(rows_of(spark, x), 3, rounds=20, tolerance=1e-7)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(found.losses, found.losses[1:], strict=False))
    assert np.sqrt(((corners[:, None] - found.places[None]) ** 2).sum(2).min(1)).max() < 0.6
    # inside the hull: each archetype is a convex combination of the corners
    w = archetypes.on_simplex(found.places, corners, 500)
    assert ((found.places - w @ corners) ** 2).sum() < 1e-4
    assert archetypes.fit(rows_of(spark, x).limit(0), 3).places.size == 0


def test_weights_on_the_simplex_by_brute_force():
    rng = np.random.default_rng(1)
    corners, x = rng.normal(0, 1, (3, 2)), rng.normal(0, 1, (40, 2))
    w = archetypes.on_simplex(x, corners, 300)
    assert (w >= 0).all() and np.allclose(w.sum(1), 1)
    grid = np.array([(a, b, 1 - a - b) for a in np.linspace(0, 1, 101) for b in np.linspace(0, 1 - a, 101)])
    best = ((x[:, None] - (grid @ corners)[None]) ** 2).sum(2).min(1)
    assert (((x - w @ corners) ** 2).sum(1) <= best + 1e-6).all()


def test_number_of_archetypes_and_anchors(spark):
    corners, x = simplex(150, 2)
    k, found = archetypes.select(rows_of(spark, x), [2, 3, 4], rounds=3, turns=2)
    assert k == 3 and len(found.places) == 3
    with pytest.raises(ValueError):
        archetypes.select(rows_of(spark, x), [])
    features = rows_of(spark, np.vstack([corners, [[0, 0, 0, 9.5]], corners @ np.diag([0.3] * 4)]))  # one that no row leans on
    ids, places, weighed = archetypes.anchor_topics(rows_of(spark, x), features, 4, least_rows=5)
    assert sorted(ids) == [0, 1, 2] and places.shape == (3, 4) and weighed.count() == len(x)
    ids, _, _ = archetypes.anchor_topics(rows_of(spark, x), features, 4)
    assert sorted(ids) == [0, 1, 2, 3]


def test_a_fork_of_two_lineages(spark):
    rng = np.random.default_rng(3)
    t = rng.uniform(0, 10, 600)
    side = np.where(rng.random(600) < 0.5, 1.0, -1.0)
    x = np.stack([t, np.where(t > 4, side * (t - 4) * 0.9, 0)], 1) + rng.normal(0, 0.08, (600, 2))
    nodes = np.array([[0.2, 0], [2, 0], [4, 0.0], [6, 1.8], [9.5, 5], [6, -1.8], [9.5, -5]])
    edges = [(0, 1, 1.8), (1, 2, 2.0), (2, 3, 2.7), (3, 4, 4.7), (2, 5, 2.7), (5, 6, 4.7)]
    fitted = curves.fit_curves(rows_of(spark, x), nodes, edges, 0, rounds=8)
    assert [w[-1] for w in fitted.ways] == [4, 6] and (np.diff(fitted.along, axis=1) >= 0).all()
    got = {r.id: r for r in curves.curve_times(rows_of(spark, x), fitted).collect()}
    rank = lambda v: np.argsort(np.argsort(v))
    for branch, sign in ((0, 1.0), (1, -1.0)):
        own = [k for k in got if t[k] < 4 or side[k] == sign]
        own = [k for k in own if got[k].times[branch] is not None]
        assert len(own) > 250 and np.corrcoef(rank(t[own]), rank([got[k].times[branch] for k in own]))[0, 1] >= 0.99
    assert np.mean([got[k].branch == (0 if side[k] > 0 else 1) for k in got if t[k] > 5.5]) > 0.98
    # the trunk is shared: both curves start together
    assert np.sqrt(((fitted.points[0][0] - fitted.points[1][0]) ** 2).sum()) < 0.05
    with pytest.raises(ValueError):
        curves.fit_curves(rows_of(spark, x), nodes[:1], [], 0)


def test_projection_on_a_broken_line():
    points = np.array([[0, 0], [2, 0], [2, 2.0]])
    at, far = curves.project(np.array([[1, 1.0], [-1, 0], [2.5, 1.5], [3, 3]]), points, np.array([0, 2.0, 4]))
    assert at.tolist() == [1.0, 0.0, 3.5, 4.0] and far == pytest.approx([1, 1, 0.25, 2])


def test_a_basis_from_landmarks_is_exact_at_full_rank(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (80, 4)) @ rng.normal(0, 1, (4, 9))
    got = linear.nystrom_basis(rows_of(spark, x), 12, seed=1)
    u = np.array([r.basis for r in sorted(got.collect(), key=lambda r: r.id)])
    assert u.shape[1] == 4 and np.allclose(u @ u.T, x @ x.T, atol=1e-6)
    fewer = np.array([r.basis for r in sorted(linear.nystrom_basis(rows_of(spark, x), 2, seed=1).collect(), key=lambda r: r.id)])
    assert fewer.shape[1] == 2 and np.trace(x @ x.T - fewer @ fewer.T) > 0
    assert linear.nystrom_basis(rows_of(spark, x).limit(0), 3).count() == 0
