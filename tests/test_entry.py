"""The driver's entry, with and without the language-model folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent.parent
PROBE = """
import sys
import __spark_entry__ as entry
from millrace.session import session
names = entry.queries()
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= set(names)
spark = session("probe", "local[2]", 2)
print("ROWS", names["needs_reembed"](spark, sys.argv[1]).count())
"""


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_runs_without_the_llm_folders(tmp_path, small, with_pipeline):
    shutil.copytree(HERE / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * with_pipeline:
        if (HERE / name).exists():
            shutil.copy(HERE / name, tmp_path / name)
    done = subprocess.run([sys.executable, "-c", PROBE, small], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in done.stdout, done.stderr[-3000:]
