"""Every query with SQL against an independent engine, on the small tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from orelode import catalog

DATA = Path(os.environ.get("ORELODE_TESTDATA", "/root/testdata/sf0.001"))
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", catalog.queries())
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert df.columns
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = sorted(df.columns)
    pick = lambda cols, rows: sorted(str([r[cols.index(c)] for c in order]) for r in rows)
    assert pick(df.columns, rows) == pick(want.columns, want.fetchall())


def test_entry_without_training_data_queries():
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [("orelode/llm", "tests/llm"), ("orelode/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_survives_deletion(tmp_path, gone):
    """Without the subpackage (and with or without the pipeline's file) the entry imports and has all the other queries."""
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "*.json", ".pytest_cache"))
    for name in gone:
        target = tmp_path / "r" / name
        shutil.rmtree(target, ignore_errors=True)
        target.unlink(missing_ok=True)
    code = "import __spark_entry__ as e, orelode.catalog as c; q = e.queries(); assert set(c.queries()) <= set(q) and set(e.oracle_sql()) <= set(q); assert 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path / "r")})
    assert done.returncode == 0, done.stderr
