"""The trace engine stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    skip = shutil.ignore_patterns(".git", "__pycache__", "llm", "*.md", "*.json")
    for pipeline in (True, False):
        at = tmp_path / str(pipeline)
        shutil.copytree(ROOT, at, ignore=skip)
        if not pipeline:
            (at / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'crossings' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        done = subprocess.run([sys.executable, "-c", code], cwd=at, env=env, capture_output=True, text=True)
        assert done.returncode == 0, done.stderr
