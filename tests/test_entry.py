"""The entry point with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

LISTING = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()), 'pipeline' in e.queries())"


@pytest.mark.parametrize("left_out", [("llm",), ("llm", "corpus_pipeline.py")])
def test_entry_without_the_subpackage(tmp_path, left_out):
    from offerlode.queries.registry import QUERIES

    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda _, names: [n for n in names if n in (".git", "__pycache__", *left_out)])
    assert not (copy / "offerlode" / "llm").exists()
    run = subprocess.run(
        [sys.executable, "-B", "-c", LISTING], cwd=copy, capture_output=True, text=True, check=True,
        env={**os.environ, "PYTHONPATH": str(copy)})
    assert run.stdout.split() == [str(len(QUERIES)), "True", "False"]
