"""Orders that must not depend on the order in which numbers were added up."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import edges, neighbours, traverse


def test_equal_personal_ranks_go_by_node(spark):
    x = np.tile(np.random.default_rng(0).normal(0, 1, (40, 8)), (6, 1))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    graph = edges.from_neighbours(neighbours.exact(points, 10))
    found = traverse.personal_ranks(graph, 5, least=2e-3).orderBy("source", F.col("rank")).collect()
    ties = [(a, b) for a, b in zip(found, found[1:], strict=False) if a.source == b.source and abs(a.score - b.score) < 1e-13]
    assert len(ties) > 100 and all(a.node < b.node for a, b in ties)


def test_equal_personal_ranks_are_equal_to_the_last_digit(spark):
    """Copies that lie alike had scores that differed in the last digits, by the order of rows, and so might fall on either side of a rounded score."""
    x = np.tile(np.random.default_rng(0).normal(0, 1, (40, 8)), (6, 1))
    points = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, features array<double>")
    graph = edges.from_neighbours(neighbours.exact(points, 10))
    scores = [{(r.source, r.node): r.score for r in traverse.personal_ranks(g, 8, least=2e-3).collect()} for g in (graph, graph.repartition(7, "dst"))]
    assert scores[0] == scores[1]
    by_source = {}
    for (source, _), score in scores[0].items():
        by_source.setdefault(source, []).append(score)
    near = [(a, b) for own in map(sorted, by_source.values()) for a, b in zip(own, own[1:], strict=False) if b - a < 1e-13]
    assert len(near) > 100 and all(a == b for a, b in near)
