import importlib
import importlib.util
import re
from pathlib import Path

import __spark_entry__ as entry


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and "p3_found" in sql and len(q) >= 40


def test_core_stands_alone(monkeypatch):
    real = importlib.util.find_spec
    monkeypatch.setattr(importlib.util, "find_spec", lambda name, *a: None if ".llm" in name else real(name, *a))
    assert not [k for k in entry.queries() if k.startswith(("p1_", "p2_", "p4_", "p7_"))]
    assert "p3_found" in entry.oracle_sql()


def test_nothing_else_imports_the_subpackage():
    root = Path(entry.__file__).parent
    core = [f for f in (*root.glob("scriptorium/**/*.py"), *root.glob("tests/*.py")) if "llm" not in f.parts and f.name != "test_entry.py"]
    assert core and not [f for f in core if re.search(r"(from|import)\s+[\w.]*\bllm\b", f.read_text())]


def test_flagship(spark):
    assert "citation" in entry.entry(spark).columns
