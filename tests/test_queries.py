import pytest
from compare import compare

import __spark_entry__ as entry
from graphloom.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: Those of many rounds; test_graphs.py covers what they do on small graphs.
LONG = {"merge_scc", "merge_levels", "scc_slota", "scc_partitioned", "scc_summary", "component_histogram", "scc_phases", "scc_small_rest"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - LONG))
def test_query_equals_sql(spark, name):
    compare(spark, SF, QUERIES[name], SQL[name])


def test_registered():
    assert set(QUERIES) == set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
