"""The registered queries against DuckDB, and the pipeline against a plain version of its stages."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone import frames
from lodestone.llm import bpe, quality_rules, queries

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, db, name):
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    rows = lambda f: sorted(repr(tuple(r)) for r in f[sorted(f.columns)].itertuples(index=False))
    assert rows(ours) == rows(theirs)


def test_pipeline(spark, db):
    import zstandard
    from tokenizers import Tokenizer

    squeeze = zstandard.ZstdCompressor(level=quality_rules.LEVEL, write_content_size=False, write_checksum=False).compress
    docs = {i: (t or "", s) for i, t, s in db.sql("select doc_id, text, source from documents").fetchall()}
    kept = {}
    for i, (t, s) in docs.items():
        n, _, _, _, again = brute.counts(t)
        if n >= 50 and 100 * again <= 50 * n and quality_rules.within_bands(t.encode(), squeeze)[2]:
            kept[i] = (t, s)
    cut = brute.without_shared_lines({i: t for i, (t, _) in kept.items()})
    kept = {i: (cut[i][2], s) for i, (_, s) in kept.items()}
    found = brute.near_components({i: t for i, (t, _) in kept.items()}, 5)
    kept = {i: v for i, v in kept.items() if found[i][1] == i}
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(i, t, s) for i, (t, s) in kept.items()])
    library, want = Tokenizer.from_file(bpe.default_path()), []
    for i, size, taken in con.sql(f"select doc_id, size, taken from ({queries.OP2_SQL})").fetchall():
        ids = library.encode(kept[i][0], add_special_tokens=False).ids
        want += [(i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False)))] * (taken // size if size else 0)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(want)
    assert len(want) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == names


def test_stages_at_the_edges(spark):
    """Nulls, repeated rows, ties, columns named like the operators' own, and no rows."""
    rng = random.Random(1)
    words = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(90))
    rows = [(None, None, None, None, None), (1, None, "en", None, 0), (2, "", "en", "a", 0), *[(3, words, "en", "a", 9)] * 2, (4, words + " more", "en", None, 9), (None, words[:-9], None, None, None), (5, words[::-1], "de", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("own") for c in ("place", "row", "kept", "cid", "n_lines", "doc")})
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = frames.cut_lineage(stage(spark, now, SF))
            assert now.columns == docs.columns, name
            assert {r.place for r in now.collect()} <= {"own"}
            ids = sorted((r.doc_id or 0) for r in now.select("doc_id").distinct().collect())
            want = [] if empty else [0, 3, 4, 5] if name in ("quality rules", "line dedup") else [0, 3, 5]
            assert ids == want or name == "source mix" and set(ids) <= set(want)  # the mix takes what the budget reaches
        assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == now.count()
