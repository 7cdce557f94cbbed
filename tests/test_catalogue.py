"""Every query with oracle SQL against DuckDB, as the driver compares them, and the entry point's contract."""

import importlib
import sys

import pytest

from compare import connect, same
from loomgraph.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(spark, con, name):
    assert not same(QUERIES[name](spark, SF), con, ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_llm(spark, monkeypatch):
    """Without the subpackage and the pipeline the other queries stay."""
    for name in [m for m in sys.modules if m.startswith("loomgraph.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.setitem(sys.modules, "loomgraph.llm", None)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
