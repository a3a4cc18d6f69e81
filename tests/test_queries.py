"""Every query that has SQL, against DuckDB on the smallest tables."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    """Rows in order, and their numbers apart: sums in another order may differ in the last digit that is kept."""
    frame = frame[sorted(frame.columns)]
    real = [c for c in frame.columns if frame[c].dtype.kind == "f"]
    order = frame.assign(**{c: frame[c].round(3) + 0.0 for c in real}).astype(str).sort_values(list(frame.columns)).index
    frame = frame.loc[order]
    return frame.drop(columns=real).map(lambda v: None if v is None or v is pd.NA or v != v else str(v)).values.tolist(), frame[real].to_numpy()


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, db, name):
    ours, theirs = catalogue.QUERIES[name](spark, SF).toPandas(), db.sql(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    (plain, real), (plain_, real_) = rows(ours), rows(theirs)
    assert plain == plain_
    np.testing.assert_allclose(real, real_, rtol=1e-6, atol=2e-6)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
