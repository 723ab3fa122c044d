"""Every registered query against its SQL on the smallest tables; the rest must run."""

import importlib
import pkgutil

import pytest
from compare import compare, duck

from millrace import plans

SF = "/root/testdata/sf0.001"


def _own():
    found, sql = {}, {}
    for m in pkgutil.iter_modules(plans.__path__):
        mod = importlib.import_module(f"millrace.plans.{m.name}")
        found |= getattr(mod, "QUERIES", {})
        sql |= getattr(mod, "ORACLE_SQL", {})
    return found, sql


FOUND, SQL = _own()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(FOUND))
def test_query(spark, con, name):
    if name in SQL:
        assert compare(spark, con, FOUND[name], SQL[name], SF) == ""
    else:
        assert FOUND[name](spark, SF).collect() is not None


def test_sql_has_queries():
    assert set(SQL) <= set(FOUND)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(FOUND) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
