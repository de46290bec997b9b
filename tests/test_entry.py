"""The registry without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registers_the_core_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/contrast", tmp_path / "contrast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = (
        "import __spark_entry__ as e; from contrast.queries import QUERIES; "
        "assert set(e.queries()) == set(QUERIES) and set(e.oracle_sql()) <= set(QUERIES)"
    )
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
