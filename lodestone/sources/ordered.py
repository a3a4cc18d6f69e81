"""Lines of text and rows of tables numbered in the order of their files, and delimited matrices read in that order.

A task reads a piece of a file and counts its lines; the counts of the pieces, a row for each, are added up in the order
of paths and of places in a file; a line's number is what comes before its piece and its place in it. So lines keep
their order and repeated lines stay apart, and no task reads more than its piece. (A compressed file is one piece.)
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..frames import cut_lineage, numbered

#: Spellings of a missing number that don't make a line a header. Fixed values.
MISSING = ("NA", "N/A", "na", "n/a")
NUMBER = r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)$"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``line``, ``no``, ``value``: all lines, with their number in their file and over all files, from 0.

    Files come in the order of their paths. Blank lines count.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), F.monotonically_increasing_id().alias("_at"), "value")
    lines = cut_lineage(read)
    pieces = lines.groupBy("file", "_piece").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("file", "_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each piece
    pieces = pieces.withColumn("_before", before).withColumn("_file", F.min("_before").over(W.partitionBy("file")))
    no = F.col("_before") + F.col("_at") - F.col("_first")
    return lines.join(pieces, ["file", "_piece"]).select("file", (no - F.col("_file")).alias("line"), no.alias("no"), "value")


def numbered_rows(spark: SparkSession, path: str, name: str = "no") -> DataFrame:
    """The rows of parquet files with `name`: their number from 0, files in the order of their paths."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c != name]
    placed = rows.select(*(F.col(f"`{c}`") for c in kept), F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    files = placed.groupBy("_file").agg((F.max("_at") + 1).alias("_n"))  # a row for each file
    before = F.coalesce(F.sum("_n").over(W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(files.select("_file", before.alias("_before")), "_file").select((F.col("_before") + F.col("_at")).alias(name), *(F.col(f"`{c}`") for c in kept))


def _pattern(delimiters: str) -> str:
    return "[" + re.escape(delimiters) + "]"


def _unquoted(field: str) -> str:
    field = field.strip()
    return field[1:-1] if len(field) > 1 and field[0] == field[-1] and field[0] in "\"'" else field


def fields_of(line: Column, delimiters: str) -> Column:
    """A line's fields at any of the delimiters, trimmed, without a pair of quotes around them."""
    return F.transform(F.split(F.rtrim(line), _pattern(delimiters)), lambda x: F.regexp_replace(F.trim(x), r"""^(["'])(.*)\1$""", "$2"))


def first_fields(spark: SparkSession, path: str, delimiters: str = "\t,", line: int = 0) -> list[str]:
    """The fields of a line, the first by default, of the first file; none if there are fewer lines."""
    names = spark.read.text(path).select(F.min("_metadata.file_path")).first()[0]
    if names is None:
        return []
    found = spark.read.text(names).limit(line + 1).collect()
    if len(found) <= line:
        return []
    return [_unquoted(f) for f in re.split(_pattern(delimiters), found[line].value.rstrip("\r\n"))]


def detect_header(spark: SparkSession, path: str, delimiters: str = "\t,") -> int | None:
    """0 if the first line is a header: if a field after the first is neither a number, nor missing, nor empty."""
    known = lambda f: not f or f in MISSING or re.match(NUMBER, f, re.IGNORECASE)
    return 0 if any(not known(f) for f in first_fields(spark, path, delimiters)[1:]) else None


def read_delimited(
    spark: SparkSession, path: str, *, delimiters: str = "\t,", header: int | str | None = "detect", row_names: int | None = 0,
    columns: list[int] | None = None, names: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """``no``, ``row``, ``features`` of a delimited text in the order of its lines, and the names of the columns.

    `header` is the header's line in each file, from 0 (lines before it are left out), None, or "detect". `row_names` is
    the column that names rows; without one they are numbered from 0. `columns` (places among all columns, the one with
    row names counted) goes before `names`; without both all other columns are read, in their order. A header that is
    one field short of the rows names the columns after the first. Blank lines are left out, ``no`` is the line's number
    over all files. A place beyond the shortest row, or a field that is no number, is an error.
    """
    if header == "detect":
        header = detect_header(spark, path, delimiters)
    head = first_fields(spark, path, delimiters, header) if header is not None else []
    lines = numbered_lines(spark, path)
    if header is not None:
        lines = lines.filter(F.col("line") > header)
    rows = lines.filter(F.trim("value") != "").select("no", fields_of(F.col("value"), delimiters).alias("f"))
    shortest, longest = rows.agg(F.min(F.size("f")), F.max(F.size("f"))).first()
    width = len(head) if shortest is None else shortest
    shift = int(bool(head) and len(head) + 1 == width and row_names == 0)
    if columns:
        chosen = sorted(set(columns))
    elif names is not None:
        chosen = [k + shift for k, c in enumerate(head) if c in set(names)]
    elif columns is not None:
        chosen = []
    else:
        chosen = [k for k in range(max(len(head), longest or 0)) if k != row_names]
    beyond = [k for k in (*chosen, *([row_names] if row_names is not None else [])) if k >= width]
    if beyond and (head or shortest is not None):
        raise ValueError(f"no column {beyond[0]}: the shortest row has {width}")
    titles = [head[k - shift] if 0 <= k - shift < len(head) else str(k) for k in chosen]
    features = F.array(*(F.element_at("f", k + 1).cast("double") for k in chosen)).cast("array<double>").alias("features")
    if row_names is None:
        rows = numbered(rows, F.col("no"), "_row")
    row = F.col("_row").cast("string") if row_names is None else F.element_at("f", row_names + 1)
    return rows.select("no", row.alias("row"), features), titles


def write_in_order(lines: DataFrame, path: str, order: Column, column: str = "value", mode: str = "errorifexists") -> None:
    """A column's values as text in files whose order of paths, and of lines in each, is that of `order`."""
    rows = lines.select(F.col(column).cast("string").alias("value"), order.alias("_order"))
    rows.repartitionByRange("_order").sortWithinPartitions("_order").select("value").write.mode(mode).text(path)
