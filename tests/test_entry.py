"""The driver's module without the training-text package."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", [("lodestone/llm", "tests/llm"), ("lodestone/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_the_rest_imports_without_the_optional_parts(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=lambda folder, names: [
        n for n in names if n in (".git", "__pycache__") or str(Path(folder, n).relative_to(ROOT)) in gone])
    says = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", says], cwd=copy, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    n, n_sql, pipeline = done.stdout.split()[-3:]
    assert int(n) >= 85 and int(n_sql) >= 80 and pipeline == "False"


def test_optional_parts_of_another_copy_are_not_taken(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "corpus_pipeline.py"))
    says = "import __spark_entry__ as e; print('pipeline' in e.queries(), 'op8_bpe' in e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", says], cwd=copy, env=os.environ | {"PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-2:] == ["False", "True"]


def test_errors_inside_the_optional_parts_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (copy / "lodestone" / "llm" / "shared.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True)
    assert done.returncode != 0 and "no_such_module_at_all" in done.stderr
