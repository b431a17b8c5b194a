"""The library without its text operators: the entry still imports and the other queries are registered."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), len(e.oracle_sql()))"


def _names(folder):
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", PROGRAM], cwd=folder, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": ""})
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def _copy(tmp_path, *left_out):
    target = tmp_path / "tree"
    shutil.copytree(ROOT, target, ignore=shutil.ignore_patterns(".git", "__pycache__", *left_out))
    return target


def test_entry_without_the_folder(tmp_path):
    queries, text, _ = _names(_copy(tmp_path, "llm"))
    assert int(queries) >= 84 and text == "False"


def test_entry_without_the_folder_and_the_pipeline(tmp_path):
    queries, text, _ = _names(_copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert int(queries) >= 84 and text == "False"
