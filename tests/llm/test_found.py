"""The registered queries over the smallest tables, against plain Python or SQL."""

import pytest
from conftest import DATA, needs_data
from factloom.llm import queries
from oracle import connection, rows


@needs_data
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    got = queries.queries()[name](spark, str(DATA)).toPandas()
    sql = queries.oracle_sql().get(name)
    if sql:
        want = connection(str(DATA)).execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@needs_data
def test_columns(spark):
    want = {
        "p2_found": ["stream_id", "shared_tokens"], "p3_found": ["origin", "ref_id", "start_line", "nl_lang"], "p5_found": ["file_id", "category"],
        "p6_found": ["file_id"], "p7_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, str(DATA)).columns == columns
