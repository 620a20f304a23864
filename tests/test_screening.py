import duckdb
import pytest

from tamis import screening

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(screening.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "supplier", "orders"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = screening.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(screening.ORACLE[name])
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want
