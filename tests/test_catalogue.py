"""Every named query against its DuckDB counterpart, on whole tables."""

import pytest
from conftest import DATA

from lamina.plans.catalogue import QUERIES
from lamina.plans.oracles import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted("|".join(map(str, r)) for r in frame.astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, str(DATA)).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda f: f.astype(object).where(f.notna(), None)
    assert rows(clean(got)) == rows(clean(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, str(DATA)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
