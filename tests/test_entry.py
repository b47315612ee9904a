"""The driver's entry file without the subpackage for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
NAMES = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    shutil.copytree(ROOT / "coursegrid", tmp_path / "coursegrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * pipeline]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", NAMES], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names = said.stdout.split()
    assert "open_seats_yearly" in names and not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names)
