"""Every registered query runs, and those with SQL return what DuckDB does."""

import duckdb
import numpy as np
import pytest

import tessera.plans  # noqa: F401
from tessera.plans import registry

TINY = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{TINY}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, con, name):
    frame = registry.QUERIES[name](spark, TINY)
    got = frame.toPandas()
    assert len(got) and len(set(frame.columns)) == len(frame.columns)
    if name not in registry.ORACLE_SQL:
        return
    want = con.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    keys = sorted(got.columns)
    got, want = (x[keys].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in keys:
        if got[c].dtype.kind == "f" or want[c].dtype.kind == "f":
            np.testing.assert_array_equal(got[c].astype(float), want[c].astype(float), err_msg=c)
        else:
            assert got[c].astype(str).tolist() == want[c].astype(str).tolist(), c


def test_entry_returns_the_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
