"""The entry module works without the training-data operators, whatever is left of their folder."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("leave", ["nothing", "a folder"])
def test_entry_without_training_operators(tmp_path, leave):
    for name in ("__spark_entry__.py", "granary"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "granary" / "llm", ignore_errors=True)
    if leave == "a folder":
        (tmp_path / "granary" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
