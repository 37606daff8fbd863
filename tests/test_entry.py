from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), *sorted(q))"


def _said(folder: Path) -> list[str]:
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_queries_load_with_the_llm_folders_deleted(tmp_path):
    for name in ("tidewatch", "__spark_entry__.py", "corpus_pipeline.py"):
        src, dst = REPO / name, tmp_path / name
        if src.is_dir():
            shutil.copytree(src, dst, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif src.exists():
            shutil.copy(src, dst)
    with_pipeline = _said(tmp_path)
    assert "brute_force" in with_pipeline and "pipeline" not in with_pipeline
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _said(tmp_path) == with_pipeline


def test_a_broken_pipeline_is_not_passed_over(tmp_path):
    shutil.copytree(REPO / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", ASK], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode and "no_such_module" in done.stderr
