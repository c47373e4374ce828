import pytest

from lumenfold import book_queries  # noqa: F401
from lumenfold import queries as Q
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, sf_dir, name):
    assert_same(Q.QUERIES[name](spark, sf_dir), Q.SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_runs(spark, sf_dir, name):
    assert Q.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_stands_alone(spark, tmp_path):
    """Without the optional folder and the pipeline, the entry module still imports and has the other queries."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lumenfold", tmp_path / "lumenfold", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) >= 40 and not any(k.startswith('op') for k in e.queries()); print(len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
