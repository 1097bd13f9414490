"""The library stands without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry


def test_queries_without_the_subpackage(monkeypatch):
    every = entry.queries()
    monkeypatch.setattr(entry, "_llm", lambda: None)
    own = entry.queries()
    assert set(own) <= set(every) and set(entry.oracle_sql()) <= set(own)


def test_nothing_else_imports_it():
    code = "import sys; from answerscope.plans.catalog import load_all; load_all(); import answerscope.streaming.jobs; print([m for m in sys.modules if m.startswith('answerscope.llm')])"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, check=True)
    assert out.stdout.strip() == "[]"
