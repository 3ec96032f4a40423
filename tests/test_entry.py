import __spark_entry__ as entry
from sentrylake import plans


def test_queries_and_sql_agree_on_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(plans.ORACLE_SQL) <= set(plans.QUERIES)


def test_imports_without_the_optional_part(monkeypatch):
    import sys

    for name in [m for m in sys.modules if m.startswith("sentrylake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)

    class Hidden:
        def find_spec(self, name, path=None, target=None):
            if name.startswith("sentrylake.llm") or name == "corpus_pipeline":
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    monkeypatch.delattr("sentrylake.llm", raising=False)
    assert set(entry.queries()) == set(plans.QUERIES)
