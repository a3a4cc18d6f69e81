"""Lookups by name: groups of keys, aliases, loci, and cells by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def match_groups(keys: DataFrame, groups: DataFrame, delimiter: str | None = None) -> DataFrame:
    """``key``, ``group``, ``rule`` for each of `keys` (``key``) by `groups` (``key``, ``group``, ``no``: file order).

    Rules in turn: ``exact``; ``base``, the text before `delimiter`; ``prefix``, a stored key that begins the
    key; ``reverse``, a stored key that the key begins; first stored key in file order; else ``unmatched``.
    Of equal stored keys the last counts. Prefixes meet by equi-joins on the text's beginnings.
    """
    stored = groups.groupBy("key").agg(F.min("no").alias("no"), F.max_by("group", "no").alias("group"))
    asked = keys.select("key").distinct()
    exact = asked.join(stored, "key").select("key", "group", F.lit(0).alias("r"), "no")
    found = [exact]
    if delimiter:
        base = asked.withColumn("b", F.substring_index("key", delimiter, 1)).join(stored.select(F.col("key").alias("b"), "group", "no"), "b")
        found.append(base.select("key", "group", F.lit(1).alias("r"), "no"))

    def beginnings(c: str) -> Column:
        return F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda n: F.substring(c, 1, n) if isinstance(n, int) else F.col(c).substr(F.lit(1), n)))

    starts = asked.filter(F.length("key") > 0).select("key", beginnings("key").alias("p"))
    found.append(starts.join(stored.select(F.col("key").alias("p"), "group", "no"), "p").select("key", "group", F.lit(2).alias("r"), "no"))
    theirs = stored.filter(F.length("key") > 0).select("group", "no", beginnings("key").alias("p"))
    found.append(asked.filter(F.length("key") > 0).select("key", F.col("key").alias("p")).join(theirs, "p").select("key", "group", F.lit(3).alias("r"), "no"))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("key").agg(F.min(F.struct("r", "no", "group")).alias("best"))
    names = F.element_at(F.array(*map(F.lit, ("exact", "base", "prefix", "reverse"))), F.col("best.r") + 1)
    rule = F.when(F.col("best").isNull(), "unmatched").otherwise(names)
    return keys.join(best, "key", "left").select("key", F.col("best.group").alias("group"), rule.alias("rule"))


def aliases(names: DataFrame, delimiter: str = "_") -> DataFrame:
    """``alias``, ``id``, ``collisions``: full names and their parts; of equal aliases the last id counts."""
    parts = names.select("id", F.explode(F.array_distinct(F.concat(F.array("name"), F.split("name", "\\Q" + delimiter + "\\E")))).alias("alias"))
    return parts.filter("alias <> ''").groupBy("alias").agg(F.max("id").alias("id"), (F.count("*") - 1).alias("collisions"))


def canonical_locus(c: Column) -> Column:
    """Without a leading chr, with ``_`` for ``:`` and ``-``."""
    return F.translate(F.regexp_replace(c, "^(chr|CHR|Chr)", ""), ":-", "__")


def members(groups: DataFrame, most: int | None = None, seed: int = 42) -> DataFrame:
    """``group``, ``id``: members, at most `most` of each group by a hash if that is asked for."""
    if most is None:
        return groups.select("group", "id")
    rank = F.row_number().over(W.partitionBy("group").orderBy(F.xxhash64(F.lit(seed), "id"), "id"))
    return groups.withColumn("_r", rank).filter(F.col("_r") <= most).select("group", "id")


def unique_groups(groups: DataFrame) -> DataFrame:
    """``group``: each one once."""
    return groups.select("group").distinct()


# -- matrices ----------------------------------------------------------------------------------------


def melt(points: DataFrame, ident: str = "id", vector: str = "features") -> DataFrame:
    """``row``, ``col``, ``value``: a cell for each place of each vector, from 0."""
    return points.select(F.col(ident).alias("row"), F.posexplode(vector).alias("col", "value"))


def from_triplets(cells: DataFrame, width: int, order: str | None = None) -> DataFrame:
    """``row``, ``features``: dense vectors of `width`; repeated cells add up, or with `order` the last one counts."""
    value = F.sum("value") if order is None else F.max_by("value", order)
    got = cells.groupBy("row", "col").agg(value.alias("v")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "v"))).alias("m"))
    places = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return got.select("row", places.alias("features"))


def to_triplets(points: DataFrame, ident: str = "id", vector: str = "features", negatives: bool = True) -> DataFrame:
    """Cells above 1e-6 in size; without `negatives`, those above it."""
    cells = melt(points, ident, vector)
    return cells.filter((F.abs("value") if negatives else F.col("value")) > 1e-6)


def one_hot(labels: DataFrame) -> DataFrame:
    """``id``, ``label``, ``value`` 1: the sparse membership matrix."""
    return labels.select("id", "label", F.lit(1.0).alias("value"))


def add_rows(table: DataFrame, updates: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the sums of `updates` added to ``value``; keys that only updates have come in."""
    return table.select(*keys, "value").unionByName(updates.select(*keys, "value")).groupBy(*keys).agg(F.sum("value").alias("value"))


def group_means(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """``group``, ``col``, ``value``, ``size``: means over a group's rows, absent cells counting as 0; `groups` has ``row``, ``group``."""
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    sums = cells.join(groups, "row").groupBy("group", "col").agg(F.sum("value").alias("s"))
    return sums.join(sizes, "group").select("group", "col", (F.col("s") / F.col("size")).alias("value"), "size")


def top_k(cells: DataFrame, k: int, weight: Column | None = None) -> DataFrame:
    """For each row its `k` cells with the largest log(1 + value)·weight above 0; ties go to the lower column."""
    score = F.log1p("value") * (F.lit(1.0) if weight is None else weight)
    scored = cells.withColumn("score", score).filter("score > 0")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), "col"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def packed(cells: DataFrame, k: int) -> DataFrame:
    """``row``, ``indices``, ``values``: the `top_k` cells by column, filled up with zeros to `k`."""
    lists = top_k(cells, k).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("t"))
    zeros = F.array_repeat(F.lit(0), k)
    return lists.select("row", F.slice(F.concat(F.transform("t", lambda x: x["col"].cast("int")), zeros), 1, k).alias("indices"), F.slice(F.concat(F.transform("t", lambda x: x["value"].cast("double")), zeros.cast("array<double>")), 1, k).alias("values"))


def subset_rows(matrix: DataFrame, rows: list) -> DataFrame:
    """``place``, ``row``, ``features``: the rows that the list names, in its order and as often."""
    asked = matrix.sparkSession.createDataFrame(list(enumerate(rows)), f"place long, row {matrix.schema['row'].dataType.simpleString()}")
    return matrix.join(F.broadcast(asked), "row").select("place", "row", "features")  # as long as the list


def gather_rows(matrix: DataFrame, ids: DataFrame) -> DataFrame:
    """`ids` (with ``row``) and the ``features`` of their rows."""
    return ids.join(matrix.select("row", "features"), "row")


def subset_columns(matrix: DataFrame, columns: list[int]) -> DataFrame:
    """``row``, ``features``: the places of the list, from 0, in its order."""
    return matrix.select("row", F.array(*(F.get("features", F.lit(c)) for c in columns)).alias("features"))


def assign_columns(target: DataFrame, source: DataFrame, columns: list[int]) -> DataFrame:
    """`target` with the features of `source` (same ``row``) at the places of the list; rows that `source` lacks stay."""
    new = source.select("row", F.map_from_arrays(F.array(*map(F.lit, columns)), "features").alias("_new"))
    put = F.transform("features", lambda x, k: F.coalesce(F.try_element_at("_new", k), x))
    return target.join(new, "row", "left").select("row", put.alias("features"))


def bind_columns(left: DataFrame, right: DataFrame) -> DataFrame:
    """``row``, ``features``: matrices side by side; both must have the same rows."""
    both = left.join(right.select("row", F.col("features").alias("_more"), F.lit(True).alias("_there")), "row", "full")
    same = F.col("features").isNotNull() & F.col("_there").isNotNull()
    return both.select("row", F.when(same, F.concat("features", "_more")).otherwise(F.raise_error(F.lit("rows differ"))).alias("features"))


def bind_rows(*blocks: DataFrame) -> DataFrame:
    """Matrices on top of each other."""
    out = blocks[0].select("row", "features")
    for block in blocks[1:]:
        out = out.unionByName(block.select("row", "features"))
    return out
