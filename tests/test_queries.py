"""Registered queries against their SQL in DuckDB, and what the driver deletes."""

import math
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from veriframe.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda x: None if x is None else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) and not math.isnan(x) else str(x)
    return sorted(columns), sorted(repr([plain(r[k]) for k in order]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for t in TABLES:
        made.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return made


def same(spark, duck, query, sql):
    got, want = query(spark, DATA), duck.execute(sql)
    return rows_of(got.columns, got.collect()) == rows_of([c[0] for c in want.description], want.fetchall())


@pytest.mark.parametrize("name", list(ORACLE))
def test_sql(spark, duck, name):
    assert same(spark, duck, QUERIES[name], ORACLE[name])


def test_cyclic_layers(spark):
    from veriframe.operators.graph import layers_of
    from veriframe.plans import views

    edges = [tuple(r) for r in views.edge_sparse(spark, DATA).select("caller", "callee").collect()]
    nodes, want = {n for e in edges for n in e}, set()
    for phase in (0, 1):
        own = [n for n in nodes if n // 3 % 2 == phase]
        want |= {(phase, n, k) for k, n in layers_of(own, edges)}
    assert {tuple(r) for r in QUERIES["caller_first_layers_cyclic"](spark, DATA).select("phase", "id", "layer").collect()} == want


def test_stream_query(spark):
    names = ["job_id", "status", "attempts"]
    rows = lambda q: sorted(map(tuple, QUERIES[q](spark, DATA).select(*names).collect()))
    assert rows("stream_job_status") == rows("job_state_machine")


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_without_llm(tmp_path):
    root = Path(contract.__file__).parent
    for part in ("veriframe", "__spark_entry__.py", "tests"):
        source = root / part
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path / part)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not [k for k in q if k[:2] == 'op' and k[2].isdigit()] and 'pipeline' not in q; e.oracle_sql()"
    env = {"PYTHONPATH": str(tmp_path), "PATH": os.environ["PATH"], "JAVA_HOME": os.environ.get("JAVA_HOME", ""), "HOME": str(tmp_path)}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
    some = ["tests/test_functions.py", "tests/test_queries.py", "-k", "test_functions or coverage or quote or batch_items or checkpoint or escalation"]
    assert subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *some], cwd=tmp_path, env=env).returncode == 0
