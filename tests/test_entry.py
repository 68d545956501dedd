"""Every registered query against DuckDB, and the entry points."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from matrel.plans import catalog

SMALL = "/root/testdata/sf0.001"
REPO = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(float(r[k])) if isinstance(r[k], float) else repr(r[k]) for k in order) for r in rows)


#: Kinds of which a few are run here; all are by the driver's comparison.
SLOW = {n for n in catalog.ORACLE_SQL if n.startswith(("grouped_", "smoother_", "preconditioned_", "krylov_", "sparse_"))} - {"grouped_lu", "grouped_svd", "grouped_ldlt_bk", "grouped_hessenberg", "krylov_cg", "krylov_idr_s", "sparse_lu", "sparse_supernodal_lu", "sparse_supernodal_ldlt", "smoother_sor", "preconditioned_ilu0"}


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_query_matches_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SMALL)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_needs_the_llm_parts(tmp_path):
    for p in ("matrel", "__spark_entry__.py"):
        (shutil.copytree if (REPO / p).is_dir() else shutil.copy)(REPO / p, tmp_path / p)
    shutil.rmtree(tmp_path / "matrel/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spmv' in q and not any(n.startswith('op1') for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)
