"""The library works without the training-data subpackage and the pipeline."""

import os
import shutil
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_without_the_optional_parts(tmp_path):
    to = tmp_path / "copy"
    shutil.copytree(TOP, to, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.json"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q; assert not any(k.startswith('op') and k[2].isdigit() for k in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=to, env=env, check=True, timeout=120)
