"""Every query with SQL agrees with DuckDB on the smallest tables."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from lexroute.plans import analytics, catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return round(float(v), 5) if hasattr(v, "quantize") else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in analytics.TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_agrees(spark, con, name):
    got, want = catalogue.queries()[name](spark, SF), con.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols, rows = want.columns, want.fetchall()
    left = sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in got.collect()), key=str)
    assert left == sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=str)


def test_context_keeps_the_first_passage(spark):
    assert all(len(r["ids"]) >= 1 for r in catalogue.context_pack(spark, SF).collect())
