import os

import duckdb
import pytest

from tamis import plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        name, path = f.removesuffix(".parquet"), f"{SF}/{f}"
        con.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def test_each_query_has_sql():
    assert plans.QUERIES.keys() == plans.ORACLE.keys()


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(plans.ORACLE[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want
