"""Every registered core query: equal to its SQL where it has one, and running where it hasn't."""

import importlib

import pytest

from lumenframe.plans import CORE_MODULES
from tests.oracle import DATA, compare

MODULES = [importlib.import_module(name) for name in CORE_MODULES]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()
