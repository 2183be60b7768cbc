"""The general problems' queries on empty tables and on ones with NULLs, repeats and clashing columns."""

import os

import pytest

import __spark_entry__ as entry
from odd import SF, odd_tables, tables_in
from tarnwork.queries import general
from test_queries import table_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    return odd_tables(tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(general.QUERIES))
def test_query(spark, folder, name):
    df = general.QUERIES[name](spark, folder)
    got = df.collect()
    if name in ORACLE:
        want = tables_in(folder).sql(ORACLE[name])
        assert table_of(df.columns, got) == table_of(want.columns, want.fetchall())
