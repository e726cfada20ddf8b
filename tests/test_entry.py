"""The driver contract without the training-data operators."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("broken", ["gone", "left over", "no pipeline", "no tokenizers"])
def test_other_queries_stay(tmp_path, broken):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    if broken in ("gone", "left over"):
        shutil.rmtree(there / "millrace/llm", ignore_errors=True)
        (there / "corpus_pipeline.py").unlink(missing_ok=True)
    if broken == "left over":
        (there / "millrace/llm/__pycache__").mkdir(parents=True)
    if broken == "no pipeline":
        (there / "corpus_pipeline.py").unlink(missing_ok=True)
    if broken == "no tokenizers":
        (there / "public_tokenizers.py").write_text("raise ImportError('not here')")
    env = os.environ | {"PYTHONPATH": str(there)}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=there, env=env, capture_output=True, text=True, check=True).stdout
    queries, sql = json.loads(out.splitlines()[-1])
    assert len(queries) > 100 and set(sql) <= set(queries)
    assert not [q for q in queries if q.startswith(("op1", "op2", "pipeline"))]
