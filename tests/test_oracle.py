"""Every registered query over the smallest tables, against its SQL twin where it has one."""

import os

import pytest

import __spark_entry__ as entry_module
from daybook.plans.compare import differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, TWINS = entry_module.queries(), entry_module.oracle_sql()


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, name):
    assert differences(QUERIES[name](spark, SF_DIR), TWINS[name], SF_DIR) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(TWINS)))
def test_query_without_twin_gives_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() == 12
