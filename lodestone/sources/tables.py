"""Reading tables and matrices with Spark's readers: parquet, delimited text (also compressed), MatrixMarket."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..frames import numbered
from .ordered import numbered_lines, numbered_rows

NUMERIC = (T.FloatType, T.DoubleType, T.IntegerType, T.LongType)


def is_parquet(path: str) -> bool:
    return path.rstrip("/").lower().endswith((".parquet", ".pq"))


def detect_delimiter(line: str) -> str:
    """Tab, else comma, else white space."""
    return "\t" if "\t" in line else "," if "," in line else r"\s+"


def split_fields(line, delimiter: str):
    """A column with a line's fields, trimmed and without surrounding quotes."""
    pattern = delimiter if delimiter == r"\s+" else "\\Q" + delimiter + "\\E"
    return F.transform(F.split(F.trim(line) if delimiter == r"\s+" else line, pattern), lambda x: F.regexp_replace(F.trim(x), r'^(["\'])(.*)\1$', "$2"))


def text_lines(spark: SparkSession, path: str, comments: str = "^#") -> DataFrame:
    """``value``: lines that aren't blank or comments. Row order isn't kept; use a key for it."""
    lines = spark.read.text(path)
    return lines.filter((F.trim("value") != "") & ~F.col("value").rlike(comments))


def header_of(spark: SparkSession, path: str) -> str | None:
    """The first line after ``##`` lines, without one leading ``#``: what `read_table` takes as header."""
    file = spark.read.text(path).select(F.min("_metadata.file_path")).first()[0]
    first = spark.read.text(file or path).filter(~F.col("value").startswith("##") & (F.trim("value") != "")).limit(1).collect()
    return first[0].value.removeprefix("#") if first else None


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A named table with every cell as text, nulls as empty text; `columns` selects, in the given order.

    Text files may be compressed; a header line gives the names, lines that start with ``#`` are skipped, and
    short rows end in empty text.
    """
    if is_parquet(path):
        df = spark.read.parquet(path)
        names = _checked(columns or df.columns, df.columns)
        return df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in names))
    head = header_of(spark, path)
    if head is None:
        return spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in columns or []]))
    delimiter = detect_delimiter(head)
    every = [x.strip().strip("\"'") for x in (head.split() if delimiter == r"\s+" else head.split(delimiter))]
    names = _checked(columns or every, every)
    # the header is the first line of its kind; lines that equal it further down are rows
    lines = numbered_lines(spark, path).filter(~F.col("value").startswith("##") & (F.trim("value") != ""))
    first = lines.agg(F.min("no")).first()[0]
    rows = lines.filter((F.col("no") > first) & ~F.col("value").startswith("#"))
    fields = rows.select(split_fields(F.col("value"), delimiter).alias("f"))
    return fields.select(*(F.coalesce(F.get("f", F.lit(every.index(c))), F.lit("")).alias(c) for c in names))


def _checked(asked: list[str], there: list[str]) -> list[str]:
    missing = [c for c in asked if c not in there]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}; the table has {', '.join(there)}")
    return asked


def first_string_column(df: DataFrame) -> int | None:
    return next((k for k, f in enumerate(df.schema) if isinstance(f.dataType, T.StringType)), None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERIC)]


def read_string_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    df = spark.read.parquet(path)
    _checked([column], df.columns)
    if not isinstance(df.schema[column].dataType, T.StringType):
        raise TypeError(f"{column} isn't text")
    return df.select(F.coalesce(column, F.lit("")).alias(column))


def matrix_of(df: DataFrame, row_name: str | None = None, indices: list[int] | None = None, names: list[str] | None = None) -> DataFrame:
    """``row``, ``features`` of a table's numeric columns; `indices` and `names` together select their union.

    Without `row_name` the first text column names rows; without any they are numbered from 0 in the order of their
    values, so that equal rows have keys of their own. (`read_matrix` numbers in the order of files.)
    """
    place = first_string_column(df)
    row_name = row_name or (df.columns[place] if place is not None else None)
    numeric = [c for c in numeric_columns(df) if c != row_name]
    if indices or names:
        chosen = [*(numeric[i] for i in indices or []), *(_checked(names or [], numeric))]
        numeric = [c for c in numeric if c in set(chosen)]
    if not numeric:
        raise ValueError("no numeric columns")
    features = F.array(*(F.col(f"`{c}`").cast("double") for c in numeric)).alias("features")
    if row_name:
        return df.select(F.col(f"`{row_name}`").cast("string").alias("row"), features)
    return numbered(df.select(features), F.col("features"), "row").select(F.col("row").cast("string").alias("row"), "features")


def read_matrix(spark: SparkSession, path: str, **selection) -> DataFrame:
    """``row``, ``features``: a matrix by its path's ending; text has row names first and no header.

    Rows of parquet without names are numbered from 0 in the order of files and rows.
    """
    if is_parquet(path):
        df = spark.read.parquet(path)
        if not selection.get("row_name") and first_string_column(df) is None:
            return matrix_of(numbered_rows(spark, path, "_no"), "_no", **{k: v for k, v in selection.items() if k != "row_name"})
        return matrix_of(df, **selection)
    line = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    if not line:
        return spark.createDataFrame([], "row string, features array<double>")
    fields = text_lines(spark, path, "^[#%]").select(split_fields(F.col("value"), detect_delimiter(line[0].value)).alias("f"))
    return fields.select(F.element_at("f", 1).alias("row"), F.transform(F.slice("f", 2, F.size("f")), lambda x: x.cast("double")).alias("features"))


def read_matrix_market(spark: SparkSession, path: str) -> tuple[tuple[int, int, int], DataFrame]:
    """(rows, columns, entries) and ``row``, ``col``, ``value`` from 0 of a coordinate file; wrong counts or places are errors."""
    lines = text_lines(spark, path, "^%").select(F.split(F.trim("value"), r"\s+").alias("f"))
    # of several files, the one with the banner has the size line
    banner = spark.read.text(path).filter(F.col("value").startswith("%%MatrixMarket")).select("_metadata.file_path").limit(1).collect()
    first = banner[0].file_path if banner else path
    head = spark.read.text(first).filter(~F.col("value").startswith("%") & (F.trim("value") != "")).limit(1).collect()
    if not head:
        raise ValueError("no header")
    shape = tuple(map(int, head[0].value.split()))
    size_line = F.array(*(F.lit(str(x)) for x in shape))
    # the size line has the shape of an entry: one row that equals it is taken off
    entries = lines.select((F.col("f")[0].cast("long") - 1).alias("row"), (F.col("f")[1].cast("long") - 1).alias("col"), F.col("f")[2].cast("double").alias("value"), (F.col("f") == size_line).alias("_head"))
    stats = entries.agg(F.count("*").alias("n"), F.sum(F.col("_head").cast("int")).alias("h")).first()
    if stats.n - 1 != shape[2]:
        raise ValueError(f"{stats.n - 1} entries, the header says {shape[2]}")
    body = entries.filter("not _head").drop("_head")
    if stats.h > 1:
        body = body.unionByName(entries.filter("_head").limit(stats.h - 1).drop("_head"))
    bad = body.filter((F.col("row") < 0) | (F.col("col") < 0) | (F.col("row") >= shape[0]) | (F.col("col") >= shape[1])).limit(1).count()
    if bad:
        raise ValueError("an entry lies outside the matrix")
    return shape, body


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """``name``: the distinct first fields of a text file."""
    return text_lines(spark, path, "^[#%]").select(F.element_at(F.split("value", r"[\t,]"), 1).alias("name")).distinct()


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """``a``, ``b``: a two-column file, tabs if there are any, else commas with doubled quotes."""
    line = header_of(spark, path)
    sep = "\t" if line and "\t" in line else ","
    got = spark.read.option("sep", sep).option("escape", '"').option("comment", "#").schema("a string, b string").csv(path)
    return got.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
