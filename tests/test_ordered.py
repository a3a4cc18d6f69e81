"""Lines and rows in the order of files: numbers, headers, selection, repeats."""

import gzip

import pytest
from pyspark.sql import functions as F

from lodestone.sources import ordered, sinks, tables


def test_lines_keep_order_and_repeats(spark, tmp_path):
    """10^5 lines, most of them repeated, in several files that are read in many pieces."""
    lines = [f"{k % 97}\t{k // 3}" if k % 1000 else "" for k in range(100_000)]
    (tmp_path / "t").mkdir()
    cuts = [0, 10, 40_000, 40_001, 90_000, 100_000]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (tmp_path / "t" / f"part-{n:02d}.txt").write_text("".join(x + "\n" for x in lines[a:b]))
    (tmp_path / "t" / "part-98.txt").write_text("")
    with gzip.open(tmp_path / "t" / "part-99.txt.gz", "wt") as f:
        f.write("last\nline")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = sorted((r.no, r.line, r.value) for r in ordered.numbered_lines(spark, str(tmp_path / "t")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [g[2] for g in got] == [*lines, "last", "line"] and [g[0] for g in got] == list(range(100_002))
    assert [g[1] for g in got] == [k for a, b in zip([*cuts[:-1], 0], [*cuts[1:], 2], strict=True) for k in range(b - a)]


def test_rows_of_parquet_keep_order(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("a"), F.lit(1.5).alias("b"))
    sinks.write_table(rows.repartitionByRange(5, "id").sortWithinPartitions("id").select("a", "b"), path)
    got = sorted((int(r.row), r.features) for r in tables.read_matrix(spark, path).collect())
    assert got == [(k, [float(k % 3), 1.5]) for k in range(5000)]
    # from a table, equal rows have keys of their own
    of = tables.matrix_of(spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a int, b int")).collect()
    assert len({r.row for r in of}) == 3 and sorted(r.features for r in of) == [[1.0, 2.0], [1.0, 2.0], [3.0, 4.0]]


def test_headers_and_selection(spark, tmp_path):
    def of(text, **options):
        path = tmp_path / f"t{len(list(tmp_path.iterdir()))}.csv"
        path.write_text(text)
        rows, names = ordered.read_delimited(spark, str(path), **options)
        return [(r.row, r.features) for r in rows.orderBy("no").collect()], names

    short = "a,b,c\nr1,1.0,2.0,3.0\n\nr2,4.0,5.0,6.0\n"  # the header has no name for the first column
    assert of(short, header=0, names=["b"]) == ([("r1", [2.0]), ("r2", [5.0])], ["b"])
    assert of(short, header=0, columns=[1], names=["c"]) == ([("r1", [1.0]), ("r2", [4.0])], ["a"])
    assert of(short, header=0, columns=[3]) == ([("r1", [3.0]), ("r2", [6.0])], ["c"])
    assert of(short) == ([("r1", [1.0, 2.0, 3.0]), ("r2", [4.0, 5.0, 6.0])], ["a", "b", "c"])
    full = 'id\t"x"\ty\nr1\t1\t"2e1"\nr1\t1\t20\nid\t7\t8\n'  # rows that repeat, one named like the header
    assert of(full) == ([("r1", [1.0, 20.0]), ("r1", [1.0, 20.0]), ("id", [7.0, 8.0])], ["x", "y"])
    assert of("1,2\n3,4\n3,4\n", row_names=None) == ([("0", [1.0, 2.0]), ("1", [3.0, 4.0]), ("2", [3.0, 4.0])], ["0", "1"])
    assert of("# about\nn,x\nr1,1\n", header=1) == ([("r1", [1.0])], ["x"])
    with pytest.raises(ValueError):
        of("r1,1,2\nr2,1\n", columns=[2])
    assert of("", header=None, names=[]) == ([], [])


def test_header_by_type(spark, tmp_path):
    def of(line):
        path = tmp_path / f"h{len(list(tmp_path.iterdir()))}.txt"
        path.write_text(line)
        return ordered.detect_header(spark, str(path))

    assert of("gene\tx\ty\n1\t2\t3\n") == 0
    assert of('gene,"100.5",NA,-3e2,,nan\n') is None
    assert of("only\n") is None and of("") is None and of("a,1.2.3\n") == 0


def test_only_the_first_line_is_the_header(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("chr\tpos\nchr\tpos\nchr1\t5\n")
    assert sorted(map(tuple, tables.read_table(spark, str(tmp_path / "t.tsv")).collect())) == [("chr", "pos"), ("chr1", "5")]
