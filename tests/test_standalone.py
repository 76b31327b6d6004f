"""The engine without the training-data operators."""

import ast
import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    """Both folders deleted, with and without corpus_pipeline.py: the rest imports, and its tests pass."""
    for name in ("sedge", "tests", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and (ROOT / "corpus_pipeline.py").exists() else [])):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    for folder in ("sedge/llm", "tests/llm"):
        shutil.rmtree(tmp_path / folder, ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'bm25_search' in e.queries() and not any(q.startswith('op') or q == 'pipeline' for q in e.queries()) and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    if pipeline:
        tests = ["tests/test_operators.py", "tests/test_properties.py", "tests/test_queries.py::test_query[bm25_search]", "tests/test_queries.py::test_every_query_has_an_oracle"]
        subprocess.run([sys.executable, "-m", "pytest", "-x", "-q", "-p", "no:cacheprovider", *tests], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


@pytest.mark.skipif(not (ROOT / "sedge/llm").exists(), reason="without the training-data operators")
def test_an_error_inside_llm_is_not_hidden(tmp_path):
    for name in ("sedge", "__spark_entry__.py", "corpus_pipeline.py"):
        (shutil.copytree if (ROOT / name).is_dir() else shutil.copy)(ROOT / name, tmp_path / name)
    (tmp_path / "sedge/llm/common.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, check=False)
    assert done.returncode and b"no_such_module" in done.stderr


def test_nothing_imports_llm():
    for path in (ROOT / "sedge").rglob("*.py"):
        if "llm" in path.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") or n == "corpus_pipeline" for n in names), path
