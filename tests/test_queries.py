"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for m in entry._OWN for n in m.QUERIES]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(n for n in OWN if n in entry.oracle_sql()))
def test_like_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert list(map(str, got)) == list(map(str, sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)))


@pytest.mark.parametrize("name", sorted(n for n in OWN if n not in entry.oracle_sql()))
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "status" in df.columns


def test_rest_imports_without_the_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['proselake.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e; assert 'doc_summary' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=60)


def test_rest_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    rest = tmp_path / "rest"
    shutil.copytree(root, rest, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "*.md", "*.json"))
    inherited = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.realpath(p) != root]
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(rest), *inherited])}
    # every other test runs; the queries stand for themselves, since they are the same code and take minutes
    got = subprocess.run([sys.executable, "-m", "pytest", "tests", "-q", "-x", "-k", "not test_queries or test_entry"], cwd=rest, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0 and "passed" in got.stdout, got.stdout[-2000:]
