"""The queries of training data on empty tables and on ones with NULLs, repeats and clashing columns."""

import os

import pytest

from odd import SF, odd_tables, tables_in
from tarnwork.llm import queries
from test_queries import table_of

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, tmp_path_factory):
    return odd_tables(tmp_path_factory.mktemp(request.param), request.param)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    got = df.collect()
    if name in queries.SQL:
        want = tables_in(folder).sql(queries.SQL[name])
        assert table_of(df.columns, got) == table_of(want.columns, want.fetchall())
