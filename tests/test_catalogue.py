import pytest

import oracle
from gleaner.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, sf_dir, name):
    oracle.same(spark, sf_dir, catalogue.queries()[name], SQL[name])


def test_every_query_has_sql():
    assert set(SQL) == set(catalogue.queries())


def test_entry_runs_without_the_llm_subpackage(spark, monkeypatch):
    import importlib
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("gleaner.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "gleaner.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(catalogue.queries())
    assert entry.entry(spark).count() > 0
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_nothing_outside_imports_the_llm_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent
    for path in (root / "gleaner").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gleaner.llm" not in path.read_text(), path
