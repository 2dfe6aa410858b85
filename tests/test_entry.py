"""The entry points in copies of the repository without the corpus part."""

import json
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
ASK = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


@pytest.mark.parametrize("leave", [[], ["corpus_pipeline.py"], ["rookery/llm/__pycache__"]])
def test_without_the_corpus_part(tmp_path, leave):
    """`leave`: what of it is still there."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT / "rookery", copy / "rookery", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", copy)
    for name in leave:
        if name.endswith(".py"):
            (copy / name).write_text("from rookery.llm import common\n")
        else:
            (copy / name).mkdir(parents=True)
    out = subprocess.run([sys.executable, "-c", ASK], cwd=copy, env=os.environ | {"PYTHONPATH": str(copy)}, capture_output=True, text=True, check=True, timeout=120)
    names, sql = json.loads(out.stdout)
    assert "top_moves" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names)
    assert set(sql) <= set(names)
