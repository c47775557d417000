"""Every registered query agrees with its SQL at the smallest scale, whatever the input order."""
import pytest
from oracle import compare, connect

from shirube import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(workload.all_queries()))
def test_query(spark, con, name):
    _, problem, _ = compare(spark, con, SF, workload.all_queries()[name], workload.all_sql().get(name))
    assert problem is None
