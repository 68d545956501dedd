"""Queries on tables whose sums are larger than the small tables': against SQL, and beyond BIGINT."""

import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
TABLES = "supplier part orders".split()


def tables(at, lineitem):
    """The small tables with another lineitem, and DuckDB's views of them."""
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"COPY (SELECT * FROM '{SMALL}/{t}.parquet') TO '{at}/{t}.parquet' (FORMAT parquet)")
    con.sql(f"COPY ({lineitem}) TO '{at}/lineitem.parquet' (FORMAT parquet)")
    for t in [*TABLES, "lineitem"]:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return con


def rows(result, columns):
    return sorted(tuple(r) for r in result.select(*columns).collect())


def test_product_chain_beyond_bigint(spark, tmp_path):
    con = tables(tmp_path, f"SELECT * REPLACE (l_quantity * 1e7 AS l_quantity) FROM '{SMALL}/lineitem.parquet'")
    sql = entry.oracle_sql()["product_chain"]
    with pytest.raises(duckdb.ConversionException):
        con.sql(sql).fetchall()
    got = rows(entry.queries()["product_chain"](spark, str(tmp_path)), ["i", "v"])
    want = sorted(con.sql(sql.replace("CAST(sum(q.v * y.v) AS BIGINT)", "sum(q.v * y.v)")).fetchall())
    assert [(i, int(v)) for i, v in got] == want and max(v for _, v in want) > 2**63


def same_as_sql(spark, at, con, name):
    columns = ["id", "i", "j", "v"]
    got = rows(entry.queries()[name](spark, str(at)), columns)
    assert got == sorted(con.sql(f"SELECT id, i, j, v FROM ({entry.oracle_sql()[name]})").fetchall())
    return got


def test_grouped_condition_halves(spark, tmp_path):
    quantities = {0: 300_000, 1: 300_001, 2: 300_000, 3: 300_000, 4: 300_000, 5: 300_000}
    lines = " UNION ALL ".join(f"SELECT CAST({50 * k + g} AS BIGINT), CAST({k} AS BIGINT), CAST(0 AS BIGINT), CAST({v + 2 * g * (k == 1)} AS DOUBLE)" for g in range(50) for k, v in quantities.items())
    con = tables(tmp_path, f"SELECT * FROM ({lines}) t(l_orderkey, l_partkey, l_suppkey, l_quantity)")
    got = same_as_sql(spark, tmp_path, con, "grouped_condition")
    assert got[0] == (0, 0, 0, 1_000_003)  # 1,000,002.5


@pytest.mark.parametrize("name", ["grouped_eigenvalue", "grouped_eigenvalue_symmetric", "grouped_hessenberg", "grouped_tridiagonal"])
def test_traces_beyond_doubles(spark, tmp_path, name):
    con = tables(tmp_path, f"SELECT * REPLACE (l_quantity * 999 AS l_quantity) FROM '{SMALL}/lineitem.parquet'")
    got = same_as_sql(spark, tmp_path, con, name)
    assert max(r[-1] for r in got) > 2**53
