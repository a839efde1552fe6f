from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from quirespark.plans import queries as library

from . import oracle


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(library.ORACLES))
def test_query_equals_its_sql(spark, small, con, name):
    oracle.same(library.QUERIES[name](spark, small), con, library.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(library.QUERIES) - set(library.ORACLES)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert library.QUERIES[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["doc_id", "idx", "level", "score", "context", "total"]


def test_entry_without_the_training_data_operators(tmp_path):
    """The rest stands by itself: the other queries are there, and their module imports, with or without the pipeline's file."""
    root, copy = Path(__file__).resolve().parent.parent, tmp_path / "repo"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q)"
    for _ in range(2):
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)
