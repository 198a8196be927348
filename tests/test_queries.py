"""Each registered query that has SQL gives the rows that DuckDB gives."""

import duckdb
import numpy as np
import pytest

from modeloom import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.execute(queries.ORACLE_SQL[name]).fetchdf()
    names = sorted(got.columns)
    assert names == sorted(want.columns) and len(got) == len(want) > 0
    got, want = (x[names].sort_values(names).reset_index(drop=True) for x in (got, want))
    for c in names:
        assert got[c].dtype == want[c].dtype
        assert np.array_equal(got[c].to_numpy(), want[c].to_numpy())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["s", "z", "v"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
