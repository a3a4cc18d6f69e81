"""Batches of exact sizes: rows in an order, or in another shuffle each epoch, and pairs whose ends are in one batch.

Rows are numbered by ranges of a keyed hash, so every row is in one batch of an epoch, all batches but the last have
`size` rows, and neither partitions nor retries change them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import numbered


def ordered_batches(rows: DataFrame, order: Column, size: int) -> DataFrame:
    """`rows` with ``no``, their number from 0 in the order of `order`, and ``batch``, that of `size` rows in a row."""
    return numbered(rows, order, "no").withColumn("batch", F.floor(F.col("no") / size))


def ordered_slice(rows: DataFrame, order: Column, low: int, high: int) -> DataFrame:
    """The rows with the numbers from `low` up to and without `high`."""
    return numbered(rows, order, "no").filter(F.col("no").between(low, high - 1))


def shuffled_batches(rows: DataFrame, ident: str, size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """`rows` with ``no`` and ``batch`` in a shuffle of its own for each `epoch`; equal ids stay together."""
    order = F.struct(F.xxhash64(F.lit(seed), F.lit(epoch), F.col(ident)), F.col(ident))
    return ordered_batches(rows, order, size)


def joint_batches(ids: DataFrame, tables: list[DataFrame], ident: str, size: int, epoch: int = 0, seed: int = 42) -> list[DataFrame]:
    """Each of `tables` with ``batch``: rows of one id are in the same batch of all tables; `ids` has each id once."""
    placed = shuffled_batches(ids.select(ident), ident, size, epoch, seed).select(ident, "batch")
    return [t.join(placed, ident) for t in tables]


def drawn_pairs(rows: DataFrame, ident: str, size: int, epoch: int = 0, seed: int = 42) -> DataFrame:
    """``batch``, ``pair``, ``a``, ``b``: rows paired at random, each row in one pair of an epoch, `size` pairs a batch.

    A last row without a partner is in no pair.
    """
    placed = shuffled_batches(rows.select(F.col(ident).alias("a")), "a", 2, epoch, seed)
    pairs = placed.groupBy(F.col("batch").alias("pair")).agg(F.min_by("a", "no").alias("a"), F.max_by("a", "no").alias("b"), F.count("*").alias("_n"))
    return pairs.filter("_n = 2").select(F.floor(F.col("pair") / size).alias("batch"), "pair", "a", "b")


def pair_batch(pairs: DataFrame, order: Column, size: int, step: int) -> DataFrame:
    """The `step`-th `size` of all pairs, going round at the end; all of them, if there are no more than `size`."""
    placed = numbered(pairs, order, "no")
    n = placed.count()
    if n <= size:
        return placed
    return placed.filter(F.pmod(F.col("no") - (step * size) % n, F.lit(n)) < size)
