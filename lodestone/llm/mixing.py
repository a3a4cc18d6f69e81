"""Mixing sources to target weights by weighted fair queueing.

Every source has a target, its share of a total budget of words. A source's documents are shuffled (by a
digest of the id) and queued; a document's virtual finish time is the source's words up to and with it,
divided by the source's target. Sources whose target is above their size queue their documents again, up to
three times. The copies are ordered by finish time over all sources, and those within the budget are taken.

Running sums over a hot source are split: each row falls in one of 64 * 64 ordered cells, cells are summed
first, and the sums before a cell are added to those within it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import cut_lineage, numbered, running

#: Most times that a document is taken.
EPOCHS = 3
CELLS = 64


def running_sum(rows: DataFrame, keys: list[str], cell: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """`rows` with `name`: the sum of `value` over the rows of the same `keys` up to and with the row.

    `cell` in [0, `CELLS`²) must not fall when `order` rises. Only sums of cells are ordered as a whole.
    """
    cells = rows.withColumn("_hi", F.floor(cell / CELLS).cast("int")).withColumn("_lo", F.pmod(cell, F.lit(CELLS)).cast("int"))
    fine = cells.groupBy(*keys, "_hi", "_lo").agg(F.sum(value).alias("_s"))
    coarse = fine.groupBy(*keys, "_hi").agg(F.sum("_s").alias("_s"))
    before = (W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    coarse = coarse.select(*keys, "_hi", F.coalesce(F.sum("_s").over(W.partitionBy(*keys).orderBy("_hi").rowsBetween(*before)), zero).alias("_base"))
    fine = fine.withColumn("_in", F.coalesce(F.sum("_s").over(W.partitionBy(*keys, "_hi").orderBy("_lo").rowsBetween(*before)), zero))
    at = [*keys, "_hi"]
    offsets = fine.join(coarse, at).select(*at, "_lo", (F.col("_in") + F.col("_base")).alias("_before"))
    within = F.sum(value).over(W.partitionBy(*at, "_lo").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return cells.withColumn(name, within).join(offsets, [*at, "_lo"]).withColumn(name, F.col(name) + F.col("_before")).drop("_hi", "_lo", "_before")


def targets(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """``source_no``, ``source``, ``source_size``, ``target``, ``budget`` for one row a source with ``source_size``.

    Sources take the weights in turn, by code point of their name, null last. A target stops at `EPOCHS` times
    the source's size; what it leaves is shared again by weight. That level is found in closed form: with the
    sources ordered by size over weight, the first whose limit is above the level that the rest would have.
    """
    ordered = numbered(sizes, F.col("source").asc_nulls_last(), "source_no")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    weighed = ordered.withColumn("weight", weight.cast("double")).withColumn("most", EPOCHS * F.col("source_size"))
    budget, heft = weighed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    limit = F.col("most") / F.col("weight")
    filled = running(weighed, [], [limit, F.col("source_no")], {"full": F.col("most"), "used": F.col("weight")})
    # what is left to a source and those after it, whose limits are higher
    level = (F.lit(budget) - F.col("full") + F.col("most")) / (F.lit(heft) - F.col("used") + F.col("weight"))
    filled = cut_lineage(filled.withColumn("level", level))
    first = filled.filter(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min(F.struct(limit, F.col("source_no"), F.col("level").alias("level")))["level"]).first()[0]
    shared = F.lit(first).cast("double") * F.col("weight")
    return filled.select("source_no", "source", "source_size", F.least(F.col("most").cast("double"), shared).alias("target"), F.lit(budget).cast("long").alias("budget"))


def place_of() -> Column:
    """The digest by which a source's documents are shuffled; equal for rows with the same id and text only."""
    return F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``doc_id``, ``place``, ``size``, ``source_size``, ``target``, ``taken`` and ``times`` for each row of `docs`.

    ``size`` counts words of ``text`` (null: 0), ``target`` is the source's, ``taken`` is ``times`` the size.
    The budget is the sum of all sizes. Null sources are one source, the last. The order within a source is
    fixed by id and text, so reruns agree; rows that tie in both are interchangeable and each have a place.
    Rows without words are never taken. An empty table gives no rows; other columns aren't looked at.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "source", F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"), place_of().alias("place"))
    rows = cut_lineage(rows)
    sizes = cut_lineage(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights))
    # Spark sends a small table of sources to every task, and else splits the rows of a hot source
    rows = rows.join(sizes, rows["source"].eqNullSafe(sizes["source"])).drop("source")
    twelve_bits = F.conv(F.substring("place", 1, 3), 16, 10).cast("int")
    queued = cut_lineage(running_sum(rows, ["source_no"], twelve_bits, [F.col("place"), F.col("doc_id")], "size", "words"))

    # copies in the order of their finish time, up to the budget
    times = F.sequence(F.lit(0), F.lit(EPOCHS - 1))
    copies = queued.filter("size > 0 and target > 0").select("source_no", "size", "place", "budget", F.explode(times).alias("epoch"), "words", "source_size", "target")
    copies = copies.withColumn("finish", (F.col("words") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    # of the powers of two, the least one up to which there are more words than the budget: later copies can't be taken
    copies = copies.withColumn("power", F.greatest(F.ceil(F.log2("finish")), F.lit(1)).cast("int"))
    top, so_far = 1, 0
    for power, words, budget in copies.groupBy("power").agg(F.sum("size"), F.max("budget")).orderBy("power").collect():  # a row for each power
        top, so_far = power, so_far + words
        if so_far > budget:
            break
    copies = copies.filter(F.col("power") <= top).drop("power")
    cell = F.least(F.floor(F.col("finish") * (CELLS * CELLS / 2.0**top)), F.lit(CELLS * CELLS - 1)).cast("int")
    order = [F.col("finish"), F.col("source_no"), F.col("epoch"), F.col("place")]
    summed = running_sum(copies, [], cell, order, "size", "so_far")
    last = summed.filter("so_far <= budget").agg(F.max(F.struct("finish", "source_no", "epoch")).alias("last")).first()["last"]  # one row
    if last is None:
        return queued.select("doc_id", "place", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("times"))
    limit = F.struct(F.lit(float(last["finish"])).alias("finish"), F.lit(int(last["source_no"])).alias("source_no"), F.lit(int(last["epoch"])).alias("epoch"))

    def taken_at(epoch: int) -> Column:
        finish = (F.col("words") + epoch * F.col("source_size")) / F.col("target")
        return F.when(F.struct(finish.alias("finish"), F.col("source_no"), F.lit(epoch).alias("epoch")) <= limit, 1).otherwise(0)

    times = F.when((F.col("size") > 0) & (F.col("target") > 0), sum((taken_at(e) for e in range(EPOCHS)), F.lit(0))).otherwise(0).cast("int")
    return queued.select("doc_id", "place", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def repeated(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of `docs`, each as often as `mix` takes it; columns may have any names.

    Rows with the same id and text share their copies. Rows without words are left out, no rows give none.
    """
    shares = mixed.filter("times > 0").groupBy("place").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    found = docs.select(F.struct(*docs.columns).alias("row"), place_of().alias("place")).join(shares, "place")
    found = found.withColumn("no", F.row_number().over(W.partitionBy("place").orderBy("place")))
    copies = F.floor(F.col("times") / F.col("rows")) + (F.col("no") <= F.col("times") % F.col("rows")).cast("int")
    return found.filter(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies.cast("int")))).select("row.*")
