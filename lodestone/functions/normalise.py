"""Normalising a matrix in long form: one row a cell, with a row key, a column key and a value.

Cells that are absent are zeros. Where an operation's result for such a zero isn't zero, it says so.
Every function adds or replaces the value column and keeps all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import with_totals


def sum_to_one(cells: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Each value over its `by`'s sum; left as it is where the sum is not above zero."""
    share = F.when(F.col("_sum") > 0, F.col(value) / F.col("_sum")).otherwise(F.col(value))
    return with_totals(cells, [by], _sum=F.sum(value)).withColumn(value, share).drop("_sum")


def unit_length(cells: DataFrame, by: str, value: str = "value", least: float = 1e-8) -> DataFrame:
    """Each value over the Euclidean length of its `by`, which counts as `least` at least."""
    squares = with_totals(cells, [by], _sum=F.sum(F.col(value) * F.col(value)))
    return squares.withColumn(value, F.col(value) / F.greatest(F.sqrt("_sum"), F.lit(least))).drop("_sum")


def centre(cells: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Each stored value less the mean of its `by`'s stored values; absent cells stay absent."""
    return with_totals(cells, [by], _mean=F.avg(value)).withColumn(value, F.col(value) - F.col("_mean")).drop("_mean")


def scale(cells: DataFrame, by: str, value: str = "value") -> DataFrame:
    """z-scores over the stored values of each `by` with the population's deviation; constant groups are centred only."""
    centred = F.col(value) - F.col("_mean")
    scaled = F.when(F.col("_spread") > 0, centred / F.col("_spread")).otherwise(centred)
    return with_totals(cells, [by], _mean=F.avg(value), _spread=F.stddev_pop(value)).withColumn(value, scaled).drop("_mean", "_spread")


def log_softmax(cells: DataFrame, by: str, value: str = "value") -> DataFrame:
    topped = with_totals(cells, [by], _top=F.max(value))
    summed = with_totals(topped, [by], _sum=F.sum(F.exp(F.col(value) - F.col("_top"))))
    return summed.withColumn(value, F.col(value) - F.col("_top") - F.log("_sum")).drop("_top", "_sum")


def softmax(cells: DataFrame, by: str, value: str = "value") -> DataFrame:
    return log_softmax(cells, by, value).withColumn(value, F.exp(value))


def log1p(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.withColumn(value, F.log1p(value))


def tf_idf(cells: DataFrame, row: str, column: str, columns: DataFrame, value: str = "value", unit: bool = False) -> DataFrame:
    """value · ln(N / (df + 1)): N counts `columns`, df a row's nonzero cells. `unit`: columns get length one.

    `columns` has a row for each column, also for empty ones. The idf is negative for rows in all columns.
    """
    # one row: how many columns there are
    total = columns.agg(F.count("*").alias("_n"))
    frequency = cells.filter(F.col(value) != 0).groupBy(row).agg(F.count("*").alias("_df"))
    weighed = cells.join(frequency, row, "left").join(F.broadcast(total)).withColumn(value, F.col(value) * F.log(F.col("_n") / (F.coalesce("_df", F.lit(0)) + 1))).drop("_n", "_df")
    return unit_length(weighed, column, value) if unit else weighed


def log_background(means: DataFrame, value: str = "value", out: str = "log_share", floor: float = 1e-3) -> DataFrame:
    """`out`: the log of each row's share of the whole, at least `floor` over the number of rows; equal shares if the whole is 0.

    Values below zero and nulls count as 0.
    """
    kept = F.greatest(F.coalesce(F.col(value).cast("double"), F.lit(0.0)), F.lit(0.0))
    sized = with_totals(means.withColumn("_kept", kept), [], _all=F.sum("_kept"), _n=F.count("*"))
    share = F.when(F.col("_all") > 0, F.col("_kept") / F.col("_all")).otherwise(1 / F.col("_n"))
    return sized.withColumn(out, F.log(F.greatest(share, floor / F.col("_n")))).drop("_kept", "_all", "_n")


def poisson_ratio(cells: DataFrame, by: str, value: str, expected: str, out: str = "ratio") -> DataFrame:
    """value / (expected · λ) where expected is above zero, λ = Σ value / Σ expected in each `by`; else the value."""
    ratio = F.when(F.col(expected) > 0, F.col(value) / (F.col(expected) * F.col("_seen") / F.col("_asked"))).otherwise(F.col(value))
    return with_totals(cells, [by], _seen=F.sum(value), _asked=F.sum(expected)).withColumn(out, ratio).drop("_seen", "_asked")


# -- values ------------------------------------------------------------------------------------------

# Fixed values of the value transform: floor of the divisor, deviations of the soft clip, and its least width.
DIVISOR_FLOOR, TANH_SPREADS, EPSILON = 0.1, 4.0, 1e-6


def anscombe(x: Column) -> Column:
    return 2 * F.sqrt(F.greatest(x, F.lit(0.0)) + 0.375)


def clean_rate(x: Column, null_rate: Column, mean: Column) -> Column:
    """A count over what its feature would have by chance, with a floor under the divisor."""
    return x / F.greatest(null_rate * mean, F.lit(DIVISOR_FLOOR))


def anscombe_residual(cells: DataFrame, row: str, column: str, value: str = "value", out: str = "residual") -> DataFrame:
    """Anscombe of the values, centred in rows, then squeezed by s·tanh(r/s) with s four deviations of the column."""
    centred = centre(cells.withColumn(out, anscombe(F.col(value))), row, out)
    s = TANH_SPREADS * F.col("_spread") + EPSILON
    return with_totals(centred, [column], _spread=F.stddev_pop(out)).withColumn(out, s * F.tanh(F.col(out) / s)).drop("_spread")


def anscombe_lite(x: Column, null_rate: Column, mean: Column) -> Column:
    """`anscombe` of the `clean_rate`."""
    return anscombe(clean_rate(x, null_rate, mean))


def log_sigmoid(x: Column) -> Column:
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def soft_clamp(x: Column, bound: float = 8.0) -> Column:
    return bound * F.tanh(x / bound)


def clamped_exp(x: Column, offset: float, ceiling: float) -> Column:
    return F.exp(F.least(x + offset, F.lit(ceiling)))


def pad_score(valid: Column) -> Column:
    return (1 - valid) * F.lit(-1e9)


# -- arrays ------------------------------------------------------------------------------------------


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def unit(v: Column, least: float = 1e-9) -> Column:
    """A vector of length one; shorter than `least`, it stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > least, F.transform(v, lambda x: x / length)).otherwise(v)


def _let(value: Column, use) -> Column:
    """`use` of a value that is computed once a row; named within a function over an array it could be computed for each element."""
    return F.transform(F.array(value), use)[0]


def array_log_softmax(v: Column) -> Column:
    def less(v: Column, top: Column) -> Column:
        return _let(top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))), lambda lse: F.transform(v, lambda x: x - lse))

    return _let(v, lambda v: _let(F.array_max(v), lambda top: less(v, top)))


def smooth_topics(log_theta: Column, alpha: float) -> Column:
    """log((1 − α)θ + α/K)."""
    return _let(log_theta, lambda v: F.transform(v, lambda x: F.log((1 - alpha) * F.exp(x) + alpha / F.size(v))))


def stick_breaking(logits: Column) -> Column:
    """Log proportions of a broken stick; the last logit isn't read, one alone gives 0."""

    def step(a: Column, x: Column) -> Column:
        rest = a["rest"] + log_sigmoid(-x)
        return F.struct(rest.alias("rest"), F.concat(a["out"], F.array(x + rest)).alias("out"))

    start = F.struct(F.lit(0.0).alias("rest"), F.array().cast("array<double>").alias("out"))
    return _let(logits, lambda v: F.aggregate(F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))), start, step, lambda a: F.concat(a["out"], F.array(a["rest"]))))


def sparsemax(v: Column) -> Column:
    """The nearest point of the simplex: sort, find how many stay above the threshold, subtract it."""

    # of the k largest: 1 + k·z_k > Σ z; the support is the last k for which that holds
    def step(a: Column, z: Column) -> Column:
        k, s = a["k"] + 1, a["s"] + z
        above = 1 + k * z > s
        return F.struct(k.alias("k"), s.alias("s"), F.when(above, (s - 1) / k).otherwise(a["t"]).alias("t"))

    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))
    threshold = lambda v: F.aggregate(F.sort_array(v, asc=False), start, step, lambda a: a["t"])
    return _let(v, lambda v: _let(threshold(v), lambda t: F.transform(v, lambda x: F.greatest(x - t, F.lit(0.0)))))


def positional_embedding(x: Column, width: int) -> Column:
    """sin and cos of x / 10000^(2i/width), alternating."""
    return F.array(*((F.sin if i % 2 == 0 else F.cos)(x / F.lit(float(10000 ** (2 * i / width)))) for i in range(width)))
