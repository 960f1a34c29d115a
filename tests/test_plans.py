import contextlib
import io
import os
import re

import pytest

from paperloom.plans import queries
from tests import sqlcheck

pytestmark = pytest.mark.skipif(not os.path.isdir(sqlcheck.SF), reason="no test tables here")


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.queries()[name](spark, sqlcheck.SF).explain("formatted")
    return out.getvalue()


def exchanges(text):
    return len(re.findall(r"^\(\d+\) (?:Exchange|BroadcastExchange)", text, re.M))


@pytest.mark.parametrize("name", ["token_estimate", "whitespace", "paragraphs", "labelled_paragraphs"])
def test_maps_do_not_shuffle(spark, name):
    p = plan(spark, name)
    assert exchanges(p) == 0 and "ReadSchema: struct<doc_id:bigint,text:string>" in p


@pytest.mark.parametrize("name", ["chunk_windows", "document_records", "full_text", "heading_sections", "chunk_manifest"])
def test_one_shuffle_by_document(spark, name):
    assert exchanges(plan(spark, name)) <= 2


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - {"strategy_grid"}))
def test_no_nested_loops(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))
