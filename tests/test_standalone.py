"""The library without its removable parts."""

import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; from tidewatch.plans import catalogue as c, catalogue_files; assert set(c.QUERIES) == set(e.queries()) and set(c.SQL) == set(e.oracle_sql()); print(len(e.queries()))"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_the_rest_imports_alone(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "spark-warehouse", "__pycache__", *also))
    got = subprocess.run([sys.executable, "-c", ASK], cwd=copy, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""}, timeout=120)
    assert got.returncode == 0, got.stderr
    assert int(got.stdout) >= 50
