"""Writing tables and matrices with Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstandard."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def write_matrix(matrix: DataFrame, path: str, columns: list[str] | None = None, row_title: str = "rowname", mode: str = "errorifexists") -> None:
    """``row``, ``features`` as a named key column and one column a feature, named 0, 1, … if not given."""
    if columns is None:
        first = matrix.select(F.size("features").alias("n")).first()
        columns = [str(k) for k in range(first.n if first else 0)]
    write_table(matrix.select(F.col("row").cast("string").alias(row_title), *(F.element_at("features", k + 1).alias(c) for k, c in enumerate(columns))), path, mode)


def write_delimited(matrix: DataFrame, path: str, sep: str = "\t", compression: str = "gzip", mode: str = "errorifexists") -> None:
    """``row``, ``features`` as text without header."""
    line = F.concat_ws(sep, F.col("row").cast("string"), F.transform("features", lambda x: x.cast("string")))
    matrix.select(line.alias("value")).write.mode(mode).option("compression", compression).text(path)


def write_grouped_stats(stats: DataFrame, path: str, keys: list[str], mode: str = "errorifexists") -> None:
    """Key columns, then ``nnz``, ``tot``, ``mu``, ``sig``."""
    write_table(stats.select(*keys, "nnz", "tot", "mu", "sig"), path, mode)


def write_parameters(planes: DataFrame, path: str, factor: str | None = None, mode: str = "errorifexists") -> None:
    """``row``, ``column``, ``mean``, ``sd``, ``log_mean``, ``log_sd``; absent planes are zeros. `factor` names the block."""
    names = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c in planes.columns else F.lit(0.0).alias(c) for c in ("mean", "sd", "log_mean", "log_sd")]
    write_table(planes.select("row", "column", *([F.lit(factor).alias("factor")] if factor else []), *names), path, mode)


def write_matrix_market(cells: DataFrame, path: str, rows: int, columns: int, mode: str = "errorifexists") -> None:
    """``row``, ``col``, ``value`` from 0 as a coordinate file from 1, the header in the first part."""
    n = cells.count()
    head = cells.sparkSession.createDataFrame([(0, "%%MatrixMarket matrix coordinate real general"), (1, f"{rows} {columns} {n}")], "no long, value string")
    body = cells.select((F.lit(2) + F.col("row") * F.lit(columns) + F.col("col")).alias("no"), F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("string")).alias("value"))
    head.unionByName(body).repartitionByRange("no").sortWithinPartitions("no").select("value").write.mode(mode).text(path)


def write_lines(df: DataFrame, path: str, column: str = "value", mode: str = "errorifexists") -> None:
    """A column's values as text, one a line."""
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_edges(edges: DataFrame, names: DataFrame, path: str, columns: tuple[str, str] = ("a", "b"), mode: str = "errorifexists") -> None:
    """The names of each edge's ends as a table of two columns; `names` has ``node``, ``name``."""
    named = edges.join(names.toDF("src", columns[0]), "src").join(names.toDF("dst", columns[1]), "dst")
    write_table(named.select(*columns), path, mode)
