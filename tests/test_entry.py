"""The entry works in a copy of the repository without its optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("without_pipeline", [False, True])
def test_entry_without_optional_folders(tmp_path, without_pipeline):
    copy = tmp_path / "copy"
    leave = ("llm", ".git", "__pycache__") + (("corpus_pipeline.py",) if without_pipeline else ())
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*leave))
    code = ("import __spark_entry__ as E; from codelake.plans.catalog import QUERIES, ORACLE; "
            "assert E.queries() == QUERIES and E.oracle_sql() == ORACLE and len(QUERIES) > 80")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
