"""Batches: exact sizes, each row once an epoch, both ends of a pair together."""

from collections import Counter

from pyspark.sql import functions as F

from lodestone.operators import epochs


def rows_of(spark, n, partitions=5):
    return spark.range(n).select((F.col("id") * 7 % 1009).alias("id"), (F.col("id") % 3).alias("x")).repartition(partitions)


def test_sizes_are_exact_and_rows_appear_once(spark):
    seen = []
    for epoch in (0, 1):
        got = epochs.shuffled_batches(rows_of(spark, 1000), "id", 64, epoch).collect()
        assert sorted(Counter(r.batch for r in got).values()) == [40, *[64] * 15] and len({r.id for r in got}) == 1000
        assert sorted(r.no for r in got) == list(range(1000)) and {r.batch for r in got if r.no >= 960} == {15}
        again = epochs.shuffled_batches(rows_of(spark, 1000, 2), "id", 64, epoch).collect()
        assert {(r.id, r.batch) for r in again} == {(r.id, r.batch) for r in got}
        seen.append([r.id for r in sorted(got, key=lambda r: r.no)])
    assert seen[0] != seen[1] and sum(a == b for a, b in zip(*seen, strict=True)) < 20


def test_order_slices_and_ties(spark):
    got = epochs.ordered_batches(rows_of(spark, 100), F.col("id"), 30).collect()
    ids = sorted(r.id for r in got)
    assert all(r.no == ids.index(r.id) and r.batch == r.no // 30 for r in got)
    assert sorted(r.id for r in epochs.ordered_slice(rows_of(spark, 100), F.col("id"), 10, 13).collect()) == ids[10:13]
    tied = epochs.shuffled_batches(spark.range(50).select(F.lit(1).alias("id")), "id", 8).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in tied) == [2, *[8] * 6]
    assert epochs.ordered_batches(rows_of(spark, 0), F.col("id"), 30).count() == 0


def test_pairs(spark):
    got = epochs.drawn_pairs(rows_of(spark, 301), "id", 40).collect()
    ends = [x for r in got for x in (r.a, r.b)]
    assert len(got) == 150 and len(set(ends)) == 300 and sorted(Counter(r.batch for r in got).values()) == [30, 40, 40, 40]
    pairs = spark.createDataFrame([(k, k + 1) for k in range(10)], "a long, b long")
    steps = [sorted(r.a for r in epochs.pair_batch(pairs, F.col("a"), 4, s).collect()) for s in range(4)]
    assert steps == [[0, 1, 2, 3], [4, 5, 6, 7], [0, 1, 8, 9], [2, 3, 4, 5]]
    assert epochs.pair_batch(pairs, F.col("a"), 99, 5).count() == 10


def test_joint_batches(spark):
    a, b = rows_of(spark, 90), rows_of(spark, 90).withColumn("y", F.lit(1))
    one, two = epochs.joint_batches(a, [a, b.unionByName(b)], "id", 20)
    first = {r.id: r.batch for r in one.collect()}
    assert sorted(Counter(first.values()).values()) == [10, 20, 20, 20, 20] and all(first[r.id] == r.batch for r in two.collect())
