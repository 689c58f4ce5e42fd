import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_reference_alone(monkeypatch):
    """Without the corpus operators the entry still imports and has the reference queries."""
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("webloom.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        def find_spec(self, name, path=None, target=None):
            if name == "corpus_pipeline" or name.startswith("webloom.llm"):
                raise ModuleNotFoundError(name, name=name)

    monkeypatch.setattr(sys, "meta_path", [Missing(), *sys.meta_path])
    alone = importlib.reload(entry)
    assert "q1_audit" in alone.queries() and not any(k.startswith("op") for k in alone.queries())
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
