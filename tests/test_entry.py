import importlib
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_names():
    sys.path.insert(0, str(ROOT))
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "hybrid_search" in entry.queries()


def test_everything_else_imports_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py", "skein", "tests"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "skein/llm", ignore_errors=True)
    shutil.rmtree(tmp_path / "tests/llm", ignore_errors=True)
    found = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert "test_catalogue" in found.stdout
    subprocess.run([sys.executable, "-c", "import skein.__main__, bench"], cwd=tmp_path, check=True)


def test_entry_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "skein"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "skein/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
