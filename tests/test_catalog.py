"""The driver's contract: every query has its SQL's columns, the flagship has rows, and deleting the llm folders breaks nothing."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from lectern.plans import catalog

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(catalog.oracle_sql()) >= 55


def test_rest_works_without_the_llm_folders(tmp_path):
    import shutil

    shutil.copytree(ROOT / "lectern", tmp_path / "lectern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    n, ops, _ = said.stdout.split()[-3:]
    assert int(n) == len(catalog.queries()) and ops == "False"
