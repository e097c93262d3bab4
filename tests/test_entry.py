"""The driver's contract, with and without the optional subpackage."""

import ast
from pathlib import Path

import __spark_entry__ as entry
from webloom.plans import registry

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_query(spark):
    assert entry.entry(spark).columns == ["domain_id", "name", "description", "expressions", "average_relevance"]


def test_names_agree():
    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_the_subpackage(monkeypatch):
    monkeypatch.setattr(entry, "_optional", lambda name: None)
    assert set(entry.queries()) == set(registry.queries()) and set(entry.oracle_sql()) == set(registry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "webloom").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith(("webloom.llm", "corpus_pipeline")) for n in names), p
