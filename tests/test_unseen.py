"""Features outside a dictionary, and modules that a context has not seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import likelihood


def test_features_outside_score_as_if_they_were_inside(spark):
    rng = np.random.default_rng(0)
    x, topics = rng.normal(0, 3, (40, 5)), rng.normal(0, 2, (3, 5))
    of = lambda ids: spark.createDataFrame([(k, x[k].tolist()) for k in ids], "id long, features array<double>")
    inside, outside = likelihood.topic_scores(of(range(25)), topics), likelihood.topic_scores(of(range(25, 40)), topics)
    kept = likelihood.normalisers(inside)
    found = likelihood.shares_of(outside, likelihood.merged(kept, likelihood.normalisers(outside)))
    score = x @ topics.T
    true = np.exp(score) / np.exp(score).sum(0)
    got = {(r.topic, r.feature): r.beta for r in found.collect()}
    assert len(got) == 45 and all(b == pytest.approx(true[f, t], rel=1e-9) for (t, f), b in got.items())


def test_unseen_modules_by_hand(spark):
    members = spark.createDataFrame([(0, 0, 0.25), (1, 0, 0.75), (2, 1, 1.0), (3, 2, 0.5), (4, 2, 0.5)], "feature long, module long, share double")
    dictionary = spark.createDataFrame([(t, f, b) for t, row in enumerate([[0.1, 0.2, 0.3, 0.2, 0.2], [0.5, 0.1, 0.1, 0.1, 0.2]]) for f, b in enumerate(row)], "topic int, feature long, beta double")
    modules = likelihood.module_dictionary(dictionary, members)
    theta = spark.createDataFrame([(7, 0, 0.4), (7, 1, 0.6)], "row long, topic int, theta double")
    totals = spark.createDataFrame([(7, 0, 5.0), (7, 1, 2.0)], "row long, module long, x double")
    visible = spark.createDataFrame([(7, 0, 1.0), (7, 2, 2.0)], "row long, feature long, x double")
    parts = likelihood.unseen_parts(theta, modules, totals, visible, members)
    got = {r.module: (r.rate, r.unseen, r.share) for r in parts.collect()}
    # module 1 was seen completely, of module 2 nothing was counted
    assert got == {0: pytest.approx((0.4 * 0.3 + 0.6 * 0.6, 4.0, 0.75)), 2: pytest.approx((0.4 * 0.4 + 0.6 * 0.3, 0.0, 1.0))}
    row = likelihood.score_unseen_multinomial(parts).first()
    assert row.llik == pytest.approx(4 * np.log(0.48 * 0.75)) and row.scored == 2
    sizes = spark.createDataFrame([(7, 7.0)], "row long, size double")
    whole = likelihood.score_unseen_nb(parts, sizes, F.lit(0.5)).first()
    want = parts.withColumn("mu", F.col("rate") * F.col("share") * 7.0).agg(F.sum(likelihood.negative_binomial(F.col("unseen"), F.col("mu"), F.lit(0.5)))).first()[0]
    assert whole.llik == pytest.approx(want) and whole.scored == 2
    half = spark.createDataFrame([(7, 0, 0.5), (7, 2, 0.5)], "row long, module long, offset double")
    assert likelihood.score_unseen_nb(parts, sizes, F.lit(0.5), half).first().llik == pytest.approx(likelihood.score_unseen_nb(parts, sizes.withColumn("size", F.lit(3.5)), F.lit(0.5)).first().llik)
