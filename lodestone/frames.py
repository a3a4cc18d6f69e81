"""What operators with several passes share: tables in the cluster's shared folder, components, and orders in ranges."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Nodes that a task holds while it contracts links.
HELD = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, which only a local master can use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: With this, Spark deletes a query's shuffle files when the query ends, not when the driver next collects garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, release: bool = False) -> DataFrame:
    """`df`, written to a table in the shared folder and read from it, so that a lost executor costs no recomputation.

    With `release` the shuffle files behind the table are deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    if release:
        before = spark.conf.get(RELEASE)
        spark.conf.set(RELEASE, "true")
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(RELEASE, before)
    else:
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete the tables of frames that `cut_lineage` gave and that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame._written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of an Arrow column without nulls as a matrix, and which of its places they have; shorter ones end in zeros, as do null components."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    there = np.arange(lengths.max(initial=0)) < lengths[:, None]
    x = np.zeros(there.shape)
    x[there] = pc.fill_null(column.flatten().cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
    return x, there


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links with the same components as those of the batches: each node with its least one, as far as a task sees."""
    parent: dict = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def stars(kind: pa.DataType) -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(root, nodes), kind)], ["a", "b"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                low, high = (a, b) if a < b else (b, a)
                parent[high] = low
        if len(parent) > HELD:
            yield stars(kind)
            parent = {}
    if parent:
        yield stars(kind)


def components(links: DataFrame) -> DataFrame:
    """``node``, ``root``: the least node of each linked node's component, for links ``a``, ``b`` of any ordered type.

    Tasks contract the links that they hold; then two steps alternate until every component is a star, each one a
    grouping and a join by node: a node's larger neighbours take over its least neighbour, then the smaller ones
    do. The number of rounds grows with the logarithm of the longest path, and no step gathers a node's neighbours.
    Nodes without links are in no row.
    """
    kind = links.schema["a"].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    edges = cut_lineage(links.filter("a <> b").select("a", "b").mapInArrow(_contracted, schema))
    while True:
        ends = F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.lit(None).alias("root")))
        of_node = edges.select(F.explode(ends).alias("end")).groupBy("end.node").agg(F.min("end.root").alias("low"), F.max("end.root").alias("high"), F.count_if(F.col("end.root").isNull()).alias("children"))
        if of_node.filter((F.col("low") != F.col("high")) | F.col("low").isNotNull() & (F.col("children") > 0)).isEmpty():
            roots = cut_lineage(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).distinct())
            drop(edges)
            return roots
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        wide = cut_lineage(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b"))
        least = wide.groupBy("a").agg(F.min("b").alias("m"))
        small = wide.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        smaller = cut_lineage(small.mapInArrow(_contracted, schema))
        drop(edges, wide)
        edges = smaller


def ranged(rows: DataFrame, *order: Column) -> DataFrame:
    """`rows` in ranges of `order`, written, with ``_part`` and ``_at``: the number of the range and the row's place in it.

    Ranges are cut by samples of the data, so a hot value of the first column is split by the next ones.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_at", 33).cast("int")).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return cut_lineage(placed)


def numbered(rows: DataFrame, order: Column, name: str) -> DataFrame:
    """`rows` with `name`: their number from 0 in the order of `order`. Only counts of ranges meet in one task."""
    placed = ranged(rows, order)
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def running(rows: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column], least: bool = False, total: str | None = None) -> DataFrame:
    """`rows` with a column for each of `values`: the sum (or the least) over the rows of the same `keys` up to and with the row.

    `order` should leave no ties. A hot key is split into ranges; only what ranges add up to meets by key. `total` names
    a further column, with the first value's sum (or least) over all rows of the same `keys`.
    """
    fold = F.min if least else F.sum
    placed = ranged(rows.withColumns({f"_v_{c}": v for c, v in values.items()}), *(F.col(c) for c in keys), *order)
    parts = placed.groupBy(*keys, "_part").agg(*(fold(f"_v_{c}").alias(f"_s_{c}") for c in values))
    earlier = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    whole = [fold(f"_s_{next(iter(values))}").over(W.partitionBy(*keys)).alias(total)] if total else []
    parts = parts.select(*(F.col(c).alias(f"_k_{c}") for c in keys), F.col("_part").alias("_range"), *(fold(f"_s_{c}").over(earlier).alias(f"_b_{c}") for c in values), *whole)
    same = F.col("_part") == F.col("_range")
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    within = W.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumns({c: fold(f"_v_{c}").over(within) for c in values}).join(parts, same)
    out = out.withColumns({c: F.least(c, f"_b_{c}") if least else F.col(c) + F.coalesce(f"_b_{c}", F.lit(0)) for c in values})
    return out.select(*(c for c in rows.columns if c not in values), *values, *([total] if total else []))


def with_totals(rows: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """`rows` with aggregates over the rows of the same `keys`: partial sums, joined back, so that no task holds a hot key's rows."""
    found = rows.groupBy(*keys).agg(*(v.alias(c) for c, v in totals.items())).withColumnsRenamed({c: f"_key_{c}" for c in keys})
    if not keys:
        return rows.join(F.broadcast(found))  # one row
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_key_{c}"))
    return rows.join(found, same).drop(*(f"_key_{c}" for c in keys))
