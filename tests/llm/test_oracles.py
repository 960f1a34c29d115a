import os

import pytest

from paperloom.llm import queries
from tests import sqlcheck

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal_to_sql(spark, name):
    sqlcheck.same(spark, queries.queries()[name], SQL[name])


@pytest.mark.skipif(not os.path.isdir(sqlcheck.SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_runs(spark, name):
    queries.queries()[name](spark, sqlcheck.SF).count()


def test_found_columns(spark):
    if not os.path.isdir(sqlcheck.SF):
        pytest.skip("no test tables here")
    expected = {
        "p1_found": {"kind": "string", "item_key": "string", "position": "int"}, "p2_found": {"document_id": "string", "source_id": "bigint"}, "p3_found": {"document_id": "string", "section_order": "int", "noise": "string"}, "p4_found": {"run_id": "bigint", "strategy": "string"},
        "p5_found": {"chunk_id_a": "string", "chunk_id_b": "string"}, "p7_found": {"result_id": "bigint", "defect": "string"}, "p8_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p9_found": {"doc_id": "bigint", "item_id": "bigint"}, "p10_found": {"doc_id_a": "bigint", "doc_id_b": "bigint"},
    }
    for name, columns in expected.items():
        assert dict(queries.queries()[name](spark, sqlcheck.SF).dtypes) == columns
