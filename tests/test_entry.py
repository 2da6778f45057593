"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TELL = """
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert set(s) <= set(q)
print(sorted(n for n in q if n.startswith("op") and n[2].isdigit() or n == "pipeline"), len(q) > 50)
"""


@pytest.mark.parametrize("gone", [(), ("corpus_pipeline.py",), ("chunkyard/llm", "tests/llm"), ("chunkyard/llm", "tests/llm", "corpus_pipeline.py")])
def test_what_is_gone_is_not_registered(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for g in gone:
        shutil.rmtree(copy / g) if (copy / g).is_dir() else (copy / g).unlink(missing_ok=True)
    left = 10 + (copy / "corpus_pipeline.py").exists() if (copy / "chunkyard/llm").exists() else 0
    said = subprocess.run([sys.executable, "-c", TELL], cwd=copy, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr
    names, rest = said.stdout.rsplit("] ", 1)
    assert names.count("'") == 2 * left and rest.strip() == "True"
