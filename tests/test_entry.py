"""The entry point with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, any(n.startswith('op1') for n in q), set(o) <= set(q))"


def said(folder):
    out = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=folder, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    return out.stdout.split()[-4:]


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    if pipeline and not (ROOT / "corpus_pipeline.py").exists():
        pytest.skip("there is no pipeline")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "llm", *([] if pipeline else ["corpus_pipeline.py"])))
    assert not (copy / "quire/llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline
    n, *flags = said(copy)
    assert int(n) > 60 and flags == ["False", "False", "True"]


def test_broken_operators_are_not_hidden(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    if not (copy / "quire/llm").exists():
        pytest.skip("there are no training-data operators")
    (copy / "quire/llm/queries.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-B", "-c", SAYS], cwd=copy, capture_output=True, text=True, timeout=120)
    assert out.returncode != 0 and "no_such_module" in out.stderr
