"""Queries with SQL agree with it."""
import pytest
from oracle import compare, connect

from shirube.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query(spark, name):
    fn, sql = QUERIES[name]
    _, problem, _ = compare(spark, connect(SF), SF, fn, sql)
    assert problem is None
