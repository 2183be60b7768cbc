"""Every registered query over the smallest tables, against its SQL where there is one."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def table_of(columns, rows):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        want = duck.sql(ORACLE[name])
        assert sorted(want.columns) == sorted(df.columns)
        assert table_of(df.columns, got) == table_of(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_of_the_vector_index(spark, sf):
    d = os.path.join(os.path.dirname(SF), sf)
    exact, found = ({(r["query_id"], r["vec_id"]) for r in entry.queries()[q](spark, d).collect()} for q in ("knn_cosine", "knn_ann"))
    assert len(exact & found) >= 0.9 * len(exact)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
