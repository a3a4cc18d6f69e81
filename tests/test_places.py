"""Places in groups whose values are mostly tied."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.frames import ranged, running
from lodestone.operators import stats


def test_a_tie_is_one_row_of_a_range(spark):
    rows = spark.range(50_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 10 < 9, F.lit(5.0)).otherwise(F.col("id") % 97).alias("x"))
    levels = rows.groupBy("k", "x").agg(F.count("*").alias("c"))
    assert ranged(levels, F.col("k"), F.col("x")).groupBy("_part").count().agg(F.max("count")).first()[0] <= 200
    got = {(r.k, r.q): r.quantile for r in stats.floor_quantiles(rows, ["k"], "x", [0.0, 0.02, 0.5, 0.97, 1.0]).collect()}
    x = {k: np.sort([5.0 if i % 10 < 9 else float(i % 97) for i in range(k, 50_000, 2)]) for k in (0, 1)}
    assert got == {(k, q): x[k][int(np.floor(q * (len(x[k]) - 1)))] for k in x for q in (0.0, 0.02, 0.5, 0.97, 1.0)}
    middle = {r.k: r["median"] for r in stats.medians(rows.filter("id < 11"), ["k"], "x").collect()}
    assert middle == {k: float(np.median([5.0 if i % 10 < 9 else float(i % 97) for i in range(k, 11, 2)])) for k in (0, 1)}


def test_running_sums_with_totals(spark):
    rows = spark.createDataFrame([("a", k, 1) for k in range(7)] + [(None, 3, 5)], "g string, k int, v int")
    got = sorted((r.g or "", r.k, r.s, r.all) for r in running(rows, ["g"], [F.col("k")], {"s": F.col("v")}, total="all").collect())
    assert got == [("", 3, 5, 5), *(("a", k, k + 1, 7) for k in range(7))]
