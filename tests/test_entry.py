import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 80


def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_without_the_training_data_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("granary.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "granary.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.import_module("__spark_entry__")
    assert bare.llm is None and not any(q.startswith("op") or q == "pipeline" for q in bare.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
