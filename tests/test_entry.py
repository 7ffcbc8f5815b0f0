"""Only an absent package is optional; a module that is missing inside it is an error."""

import importlib

import pytest

import __spark_entry__ as entry


def test_optional_modules(monkeypatch):
    def missing(name):
        def fail(_):
            raise ModuleNotFoundError(name, name=name)

        return fail

    known = ("gyre.llm", "gyre.llm.queries")
    for name in known:
        monkeypatch.setattr(importlib, "import_module", missing(name))
        assert entry._optional("gyre.llm.queries", *known) is None
    for name in ("gyre.llm.words", "numpy"):
        monkeypatch.setattr(importlib, "import_module", missing(name))
        with pytest.raises(ModuleNotFoundError):
            entry._optional("gyre.llm.queries", *known)


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
