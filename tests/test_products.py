"""Sparse products by blocks against products by terms and NumPy."""

import numpy as np
import pytest

from matrel.functions.accumulators import PLAIN, WHOLE, Accumulator
from matrel.operators import products, views
from matrel.relation import Matrix, matrix


def entries(m):
    return sorted(((r["i"], r["j"], r["v"]) for r in m.df.collect()), key=repr)


def sparse(spark, nrows, ncols, n, seed):
    """Random entries, some places twice, and one column that is full."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), int(j), int(v)) for i, j, v in zip(rng.integers(0, nrows, n), rng.integers(0, ncols, n), rng.integers(-9, 10, n), strict=True)]
    return Matrix(spark.createDataFrame(rows + rows[:5] + [(i, 3, 1) for i in range(nrows)], "i long, j long, v long"), nrows, ncols)


@pytest.mark.parametrize("nrows,ncols,accumulator", [(150, 40, PLAIN), (40, 150, PLAIN), (150, 40, WHOLE), (40, 20, Accumulator(exact=True))])
def test_blocked_product(spark, monkeypatch, nrows, ncols, accumulator):
    a, b = sparse(spark, nrows, 30, 200, 1), views.transposed(sparse(spark, ncols, 30, 200, 2))
    want = entries(products.matmul(a, b, accumulator))
    for at in ({"BLOCKS": 3, "PACKED": 7}, {"BLOCK": 1}):
        with monkeypatch.context() as m:
            for name, value in {"PLACES": 0, **at}.items():
                m.setattr(products, name, value)
            out = products.matmul(a, b, accumulator)
            assert out.df.columns == ["i", "j", "v"] and entries(out) == want


def test_blocked_product_of_odd_entries(spark, monkeypatch):
    a = Matrix(spark.createDataFrame([(0, 0, 5), (0, 1, None), (2, None, 4), (None, 1, 3), (1, 1, 2)], "i long, j long, v long"), 3, 2)
    b = Matrix(spark.createDataFrame([(0, 0, 7), (1, 4, None), (1, None, 2), (None, 2, 9)], "i long, j long, v long"), 2, 5)
    want = entries(products.matmul(a, b))
    empty = Matrix(a.df.limit(0), 3, 2)
    monkeypatch.setattr(products, "PLACES", 0)
    assert entries(products.matmul(a, b)) == want
    assert entries(products.matmul(empty, b)) == []
    with pytest.raises(Exception, match="overflow"):
        products.matmul(matrix(spark, np.array([[2**40]])), matrix(spark, np.array([[2**40]]))).df.collect()


def test_large_products_shuffle_no_terms(spark):
    """The sums are formed where the last exchange puts the blocks: before, each term went through an exchange by its place."""
    a = sparse(spark, 1100, 50, 3000, 3)
    out = products.matmul(a, views.transposed(a))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("Exchange")]
    assert above.count("Generate") == 2 and "SortMergeJoin" not in above and "BroadcastHashJoin" not in above
    dense = np.zeros((1100, 50), int)
    for r in a.df.collect():
        dense[r["i"], r["j"]] += r["v"]
    got = np.zeros((1100, 1100), int)
    rows = out.df.collect()
    for r in rows:
        got[r["i"], r["j"]] = r["v"]
    assert len(rows) == 1100**2 and (got == dense @ dense.T).all()


def test_large_gram_shuffles_no_terms(spark):
    a = sparse(spark, 1100, 50, 200, 4)
    out = products.syrk(a).df
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[: plan.index("Exchange")].count("Generate") == 2
    assert out.where("i = j and i < 10").count() == 10
