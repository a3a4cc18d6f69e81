"""Draws keyed by row and seed, so that neither partitions nor retries change them; batches and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import running


def uniform(seed: int, *keys: str | Column) -> Column:
    """A number in (0, 1)."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 45)) + 0.5) / (1 << 45)


def normal(seed: int, *keys: str | Column) -> Column:
    """A standard normal number."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit(1), *keys))) * F.cos(6.283185307179586 * uniform(seed, F.lit(2), *keys))


def exponential(seed: int, *keys: str | Column) -> Column:
    return -F.log(uniform(seed, *keys))


def bootstrap(rows: DataFrame, ident: str, seed: int = 42) -> DataFrame:
    """`rows` with ``times``: how often a bootstrap of the table's size draws each, Poisson with mean one."""
    u, cumulated, term, times = uniform(seed, ident), 0.0, 2.718281828459045**-1, F.lit(0)
    for k in range(10):
        cumulated += term
        times = times + (u > cumulated).cast("int")
        term /= k + 1
    return rows.withColumn("times", times)


def poisson_thin(cells: DataFrame, share: float, keys: list[str], value: str = "value", seed: int = 42, most: int = 64) -> DataFrame:
    """Each count replaced by the number of its units that a keyed draw keeps; values not above 0 are 0.

    Counts of over `most` take the rounded normal approximation.
    """
    small = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col(value), F.lit(float(most))), F.lit(1.0)).cast("int")), F.lit(0), lambda a, k: a + (uniform(seed, *keys, k) < share).cast("int"))
    large = F.greatest(F.round(F.col(value) * share + F.sqrt(F.col(value) * share * (1 - share)) * normal(seed, *keys)), F.lit(0.0)).cast("int")
    return cells.withColumn(value, F.when(~(F.col(value) > 0) | F.isnan(F.col(value).cast("double")), 0).when(F.col(value) <= most, small).otherwise(large))


def batches(rows: DataFrame, ident: str, size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """`rows` with ``batch``: a shuffle into batches of about `size`, another one in each epoch."""
    n = rows.count()
    many = max(1, -(-n // size))
    return rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), ident), F.lit(many)).cast("int"))


def down_sample(rows: DataFrame, group: str, ident: str, most: int, seed: int = 42) -> DataFrame:
    """At most `most` rows of each group, those with the least hashes."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), ident), ident))
    return rows.withColumn("_r", rank).filter(F.col("_r") <= most).drop("_r")


def block_rows(features: int) -> int:
    """Rows of a block that keep it near a million cells."""
    return max(100, min(10_000, 1_000_000 // max(features, 1)))


def budget_blocks(sizes: DataFrame, budget: int) -> DataFrame:
    """``id``, ``block`` for ``id``, ``bytes``: blocks in the order of ids that each begin a new multiple of `budget` bytes."""
    placed = running(sizes, [], [F.col("id")], {"_to": F.col("bytes")})
    return placed.select("id", F.floor((F.col("_to") - F.col("bytes")) / budget).alias("block"))
