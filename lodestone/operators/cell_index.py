"""An index of vectors that is built once and searched many times: rows by cells of a coarse clustering, in files of their own.

    centroids/   a row for each cell: its number, its centroid and how many rows it holds
    members/     the rows, a folder for each cell and files of a bounded number of rows
    names/       where a row is: ids with their cells, in ranges of ids, so that a few are found without reading all

A search fits nothing. It assigns its queries to the nearest cells and reads the folders of these cells only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import cut_lineage, drop
from ..functions.normalise import doubles
from .clusters import fit_centroids
from .neighbours import BLOCK, _best, _matrix, _visited

#: Rows a cell on which centroids are fitted; cells for whose centroids a driver has room.
FITTED, MOST_CELLS = 256, 1 << 16


def _finite(v: str = "v"):
    return F.col(v).isNotNull() & ~F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def build(points: DataFrame, path: str, *, cells: int | None = None, ident: str = "id", vector: str = "features", seed: int = 20240517, rounds: int = 10, mode: str = "errorifexists") -> None:
    """Write an index of all rows of `points` with an id and a vector of finite numbers to `path`.

    There are about √n cells, at most `MOST_CELLS`; they are fitted on `FITTED` rows a cell, drawn by a hash of the id, and every
    row is put into the nearest one. A cell with many rows is written, and later searched, in slices by its own count.
    """
    rows = cut_lineage(points.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).filter(F.col("id").isNotNull() & _finite()))
    n = rows.count()
    cells = max(1, min(cells or int(np.ceil(np.sqrt(n))), n, MOST_CELLS)) if n else 0
    centroids = fit_centroids(rows, cells, seed=seed, rounds=rounds, most_rows=FITTED * cells) if n else np.zeros((0, 0))
    placed = cut_lineage(rows.mapInArrow(_assigner(centroids, 1), "id long, v array<double>, cells array<int>").select("id", "v", F.element_at("cells", 1).alias("cell")))
    counts = cut_lineage(placed.groupBy("cell").agg(F.count("*").alias("members")))  # a row for each cell
    spark = points.sparkSession
    model = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(centroids)], "cell int, centroid array<double>")
    model.join(counts, "cell", "left").select("cell", "centroid", F.coalesce("members", F.lit(0)).alias("members")).coalesce(1).write.mode(mode).parquet(f"{path}/centroids")
    slices = F.greatest(F.ceil(F.col("members") / BLOCK), F.lit(1))
    sliced = placed.join(counts, "cell").withColumn("slice", F.pmod(F.xxhash64("id"), slices).cast("int")).drop("members")
    sliced.repartition("cell", "slice").write.mode(mode).partitionBy("cell").parquet(f"{path}/members")
    sliced.select("id", "cell").repartitionByRange("id").sortWithinPartitions("id").write.mode(mode).parquet(f"{path}/names")
    drop(rows, placed, counts)


def _assigner(centroids: np.ndarray, probes: int):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1).to_pylist()).reshape(batch.num_rows, -1)
                d = (v * v).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * v @ centroids.T
                near = np.argsort(d, axis=1, kind="stable")[:, :probes]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near.tolist(), pa.list_(pa.int32()))], ["id", "v", "cells"])

    return assign


def _centroids(spark: SparkSession, path: str) -> np.ndarray:
    return np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()], float)


def members(spark: SparkSession, path: str, cells: list[int] | None = None) -> DataFrame:
    """``id``, ``v``, ``slice``, ``cell`` of the rows in `cells`: only their folders are read."""
    table = spark.read.schema("id long, v array<double>, slice int, cell int").parquet(f"{path}/members")
    return table if cells is None else table.filter(F.col("cell").isin(cells))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int = 16, others: bool = False, ident: str = "id", vector: str = "features") -> DataFrame:
    """``id``, ``rank``, ``other``, ``distance``: the `k` nearest rows of the index among the `probes` nearest cells of each query.

    With as many probes as cells it is exact. `others` leaves out the row with the query's own id. Queries without an
    id or with a vector that isn't whole find nothing. A query is sent once to each part of the cells, with the numbers of those
    it visits: a row for each cell with the vector in it compresses so well that Spark took the table for small, and broadcast it.
    """
    centroids = _centroids(spark, path)
    rows = queries.select(F.col(ident).cast("long").alias("id"), doubles(F.col(vector)).alias("v")).filter(F.col("id").isNotNull() & _finite())
    if not centroids.size:
        return spark.createDataFrame([], "id long, rank int, other long, distance double")
    rows = cut_lineage(rows)
    near = rows.mapInArrow(_assigner(centroids, probes), "id long, v array<double>, cells array<int>").select(F.explode("cells").alias("cell"))
    wanted = [r.cell for r in near.distinct().collect()]  # a row for each cell
    sizes = np.zeros(len(centroids), int)
    for r in spark.read.parquet(f"{path}/centroids").collect():
        sizes[r.cell] = r.members
    sizes[np.setdiff1d(np.arange(len(sizes)), wanted)] = 0
    homes = members(spark, path, wanted if len(wanted) < len(sizes) else None)
    return _best(_visited(rows, rows.count(), homes, sizes, centroids, probes, k, others), k).select("id", "rank", "other", "distance")


def vectors_of(spark: SparkSession, path: str, names: DataFrame) -> DataFrame:
    """``id``, ``features`` of the rows of the index that `names` (``id``) asks for; of the members only their cells are read."""
    found = cut_lineage(spark.read.parquet(f"{path}/names").join(names.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi"))
    cells = [r.cell for r in found.select("cell").distinct().collect()]
    return members(spark, path, cells).join(found.select("id"), "id", "left_semi").select("id", F.col("v").alias("features"))


def search_by_name(spark: SparkSession, path: str, names: DataFrame, k: int, *, probes: int = 16) -> DataFrame:
    """`search` for rows of the index itself, given by ``id``; ids that it doesn't have find nothing."""
    return search(spark, path, vectors_of(spark, path, names), k, probes=probes, others=True)
