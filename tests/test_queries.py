"""Every query that has SQL gives the same rows as DuckDB on the smallest tables; all others run."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
Q, S = entry.queries(), entry.oracle_sql()


def canon(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(DATA + "/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(n for n in Q if n in S))
def test_matches_sql(spark, con, name):
    a, b = Q[name](spark, DATA).toPandas(), con.sql(S[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and canon(a) == canon(b)


@pytest.mark.parametrize("name", sorted(n for n in Q if n not in S))
def test_runs(spark, name):
    assert Q[name](spark, DATA).count() >= 0


def test_without_the_subpackage(tmp_path):
    """The library, its queries and the entry work without forgeline.llm."""
    import shutil

    root = os.path.dirname(entry.__file__)
    shutil.copytree(os.path.join(root, "forgeline"), tmp_path / "forgeline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'p4_found' in q and 'p1_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
