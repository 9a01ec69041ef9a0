"""Every query of the analytics part runs on the smallest tables and agrees with its DuckDB twin."""

import math
import os

import duckdb
import pytest

from orrery import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool | str):
        return str(v)
    return f"{float(v):.6g}" if isinstance(v, float) and not math.isnan(v) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    rows = got.collect()
    assert rows
    if name in plans.ORACLE:
        want = duck.execute(plans.ORACLE[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())
