"""The driver's contract holds with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

HOME = Path(__file__).resolve().parent.parent


def test_the_rest_works_without_the_optional_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(HOME, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse"))
    for extra in ("sheaf/llm", "tests/llm"):
        shutil.rmtree(copy / extra, ignore_errors=True)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'running_total' in q and 'running_total' in s and 'pipeline' not in q"
    for kept in (True, False):
        if not kept:
            (copy / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr
