"""Gamma posteriors of count matrices, in long form: ``row``, ``column``, ``a``, ``b``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import digamma, trigamma

KEYS = ["row", "column"]


def prior(cells: DataFrame, a0: float = 1.0, b0: float = 1.0, rows: DataFrame | None = None) -> DataFrame:
    """The prior at each of `cells`; `rows` (``row``, ``a0``, ``b0``) overrides it for its rows."""
    base = cells.select(*KEYS).withColumn("a", F.lit(float(a0))).withColumn("b", F.lit(float(b0)))
    if rows is None:
        return base
    return base.join(rows, "row", "left").select(*KEYS, F.coalesce("a0", "a").alias("a"), F.coalesce("b0", "b").alias("b"))


def add(params: DataFrame, stats: DataFrame) -> DataFrame:
    """a + da, b + db with `stats` (``row``, ``column``, ``da``, ``db``); cells without statistics stay."""
    s = stats.groupBy(*KEYS).agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    return params.join(s, KEYS, "left").select(*KEYS, (F.col("a") + F.coalesce("da", F.lit(0.0))).alias("a"), (F.col("b") + F.coalesce("db", F.lit(0.0))).alias("b"))


def calibrate(params: DataFrame, logs: bool = True) -> DataFrame:
    """``mean`` a/b, ``sd`` √a/b and with `logs` ``log_mean`` ψ(a) − ln b, ``log_sd`` √ψ′(a)."""
    out = params.withColumn("mean", F.col("a") / F.col("b")).withColumn("sd", F.sqrt("a") / F.col("b"))
    return out.withColumn("log_mean", digamma("a") - F.log("b")).withColumn("log_sd", F.sqrt(trigamma("a"))) if logs else out


def evidence_mean(params: DataFrame, a0: float, b0: float) -> DataFrame:
    """``evidence`` (a − a0) / (b − b0) where the data support the cell (a > a0), else 0."""
    return params.withColumn("evidence", F.when((F.col("a") > a0) & (F.col("b") > b0), (F.col("a") - a0) / (F.col("b") - b0)).otherwise(0.0))


def supported(params: DataFrame, a0: float) -> DataFrame:
    """Cells that carry more than the prior; the others' means count as 0 and have no row."""
    return params.filter(F.col("a") > a0)


def stack(*blocks: DataFrame) -> DataFrame:
    """Blocks of rows on top of each other; they must not share rows."""
    out = blocks[0]
    for block in blocks[1:]:
        out = out.unionByName(block)
    return out


def sample(params: DataFrame, seed: int = 42) -> DataFrame:
    """``draw``: a gamma variate of each cell by Marsaglia and Tsang's rejections, its randomness keyed by seed and cell.

    Eight tries are made within one expression; all fail with a chance below 1e-10, and then the mode is given.
    """
    from pyspark.sql import Column

    def uniform(k: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *KEYS), F.lit(1 << 45)) + 0.5) / (1 << 45)

    raised = F.when(F.col("a") < 1, F.col("a") + 1).otherwise(F.col("a"))
    d = raised - 1.0 / 3
    c = 1 / F.sqrt(9 * d)
    tries = []
    for k in range(8):
        x = F.sqrt(-2 * F.log(uniform(3 * k))) * F.cos(6.283185307179586 * uniform(3 * k + 1))
        v = F.pow(1 + c * x, F.lit(3.0))
        fits = (v > 0) & (F.log(uniform(3 * k + 2)) < 0.5 * x * x + d - d * v + d * F.log(v))
        tries.append(F.when(fits, d * v))
    down = F.when(F.col("a") < 1, F.pow(uniform(99), 1 / F.col("a"))).otherwise(1.0)
    return params.withColumn("draw", F.coalesce(*tries, d) * down / F.col("b"))


def melted(params: DataFrame) -> DataFrame:
    """``row``, ``column``, ``mean``, ``sd``, ``log_mean``, ``log_sd``, as parameter files have them."""
    return calibrate(params).select(*KEYS, "mean", "sd", "log_mean", "log_sd")
