"""The entry point without the optional text operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(*sorted(q))"
    return set(subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split())


def copy(folder):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, folder)
    shutil.copytree(ROOT / "fathom", folder / "fathom", ignore=shutil.ignore_patterns("__pycache__"))


def test_without_the_optional_folder(tmp_path):
    copy(tmp_path)
    every = names(tmp_path)
    shutil.rmtree(tmp_path / "fathom" / "llm", ignore_errors=True)
    rest = names(tmp_path)
    assert rest and rest == {n for n in every if n != "pipeline" and not (n.startswith("op") and n[2:3].isdigit())}


def test_without_anything_optional(tmp_path):
    copy(tmp_path)
    shutil.rmtree(tmp_path / "fathom" / "llm", ignore_errors=True)
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert names(tmp_path)
