"""The driver contract, with and without the optional parts."""

import importlib
import sys

import pytest

import __spark_entry__ as entry


def test_names():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 80


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["list_id", "item", "brand", "score", "new_position"] and df.count() > 0


def test_without_the_optional_parts(monkeypatch):
    monkeypatch.setattr(entry, "_optional", lambda m: None)
    names = set(entry.queries())
    assert names and not any(n.startswith("op") for n in names) and set(entry.oracle_sql()) <= names
    for name in [m for m in sys.modules if m.startswith("fathomlake") and ".llm" not in m]:
        importlib.import_module(name)


def test_a_missing_dependency_leaves_the_rest(monkeypatch, tmp_path):
    assert entry._optional("json") and entry._optional("no_such_package.part") is None
    (tmp_path / "lacking_module.py").write_text("import no_such_dependency\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.warns(UserWarning, match="no_such_dependency"):
        assert entry._optional("lacking_module") is None
    (tmp_path / "broken_module.py").write_text("raise ValueError('broken')\n")
    with pytest.raises(ValueError):
        entry._optional("broken_module")
    assert len(entry.queries()) > 80
