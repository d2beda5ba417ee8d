import sys

import __spark_entry__
from trackframe import catalog


def test_entry_has_all_queries_of_the_catalog():
    queries, oracles = catalog.load()
    assert set(queries) <= set(__spark_entry__.queries())
    assert set(oracles) <= set(__spark_entry__.oracle_sql())


def test_optional_parts_may_be_absent():
    def absent():
        raise ModuleNotFoundError("gone", name="some.part")

    assert __spark_entry__._optional(absent, "some.part") == ({}, {})
    try:
        __spark_entry__._optional(absent, "another")
    except ModuleNotFoundError:
        return
    raise AssertionError("a missing dependency must show")


class Absent:
    """Finds that the package of corpus operators is not there."""

    def find_spec(self, name, path=None, target=None):
        if name == "trackframe.llm":
            raise ModuleNotFoundError("gone", name=name)


def test_catalog_stays_without_the_corpus_operators(monkeypatch):
    """The pipeline's module may still be there when what it imports is not."""
    for name in [n for n in sys.modules if n.startswith("trackframe.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    queries, oracles = catalog.load()
    assert set(__spark_entry__.queries()) == set(queries)
    assert set(__spark_entry__.oracle_sql()) == set(oracles)


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
