"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def names(folder):
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(*q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True).stdout.split()


def copy_without(tmp_path, *gone):
    to = tmp_path / "copy"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", "*.md", "*.json"))
    for g in gone:
        target = to / g
        if target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()
    return to


def test_everything_is_registered():
    found = names(ROOT)
    numbered = {n[2:].split("_")[0] for n in found if n.startswith("op") and n[2].isdigit()}
    there = (ROOT / "canopy" / "llm").is_dir()
    assert numbered == {str(k) for k in range(1, 11)} if there else not numbered
    assert ("pipeline" in found) == there


def test_the_rest_works_without_the_operators(tmp_path):
    """With only the two folders gone, and with the pipeline's file gone as well."""
    for k, gone in enumerate((["canopy/llm", "tests/llm"], ["canopy/llm", "tests/llm", "corpus_pipeline.py"])):
        left = names(copy_without(tmp_path / str(k), *gone))
        assert len(left) > 70 and "pipeline" not in left and not any(n.startswith("op") and n[2].isdigit() for n in left)
