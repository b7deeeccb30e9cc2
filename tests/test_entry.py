import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__

ROOT = Path(__file__).resolve().parents[1]
SMALL = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("fringe/llm",)], ids=["neither", "pipeline", "operators"])
def test_imports_without_the_optional_part(tmp_path, left):
    """With both folders deleted, whether the pipeline's file is still there or not, and without the pipeline alone."""
    if not all((ROOT / name).exists() for name in left):
        pytest.skip("the optional part is gone here as well")
    ignored = shutil.ignore_patterns("__pycache__") if "fringe/llm" in left else shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "fringe", tmp_path / "fringe", ignore=ignored)
    for name in ("__spark_entry__.py", *(x for x in left if x.endswith(".py"))):
        shutil.copy(ROOT / name, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(sum(k.startswith('op') for k in q), 'pipeline' in q, len(q) > 40, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}).stdout
    assert out.split() == ["13" if "fringe/llm" in left else "0", "False", "True", "True"]


@pytest.mark.skipif(not Path(SMALL).is_dir(), reason="needs the test tables")
def test_entry_runs(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["v", "u", "re", "im", "hits"] and rows.count() > 0
