"""Products by groups of rows and columns against products by terms, NumPy, and what is shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrel.operators import _gathered, products, views
from matrel.relation import Matrix
from tests.test_products import entries, sparse


def shuffled(spark, df):
    """Bytes of shuffle written while ``df`` is made."""
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()

    def total():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, context._gateway.new_array(context._gateway.jvm.double, 0), None)
        return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


@pytest.mark.parametrize("at", [{"GROUPS": 3}, {"GROUPS": 1, "HELD": 60, "BUCKETS": 50}, {"GROUPS": 5, "PACKED": 16}])
def test_gathered_product(spark, monkeypatch, at):
    a, b = sparse(spark, 150, 30, 200, 1), views.transposed(sparse(spark, 40, 30, 200, 2))
    want, square = entries(products.matmul(a, b)), entries(products.matmul(a, views.transposed(a)))
    monkeypatch.setattr(products, "PLACES", 0)
    monkeypatch.setattr(products, "ENTRIES", 0)
    for name, value in at.items():
        monkeypatch.setattr(_gathered, name, value)
    for out, rows in ((products.matmul(a, b), want), (products.matmul(views.transposed(b), views.transposed(a)), sorted(((j, i, v) for i, j, v in want), key=repr)), (products.syrk(a), square)):
        assert out.df.columns == ["i", "j", "v"] and "MapInArrow" in out.df._jdf.queryExecution().executedPlan().toString()
        assert entries(out) == rows


def test_products_that_are_not_gathered(spark, monkeypatch):
    """Entries without value or place, and sums that long may not hold, go another way with the same rows."""
    a = Matrix(spark.createDataFrame([(0, 0, 5), (0, 1, None), (2, None, 4), (None, 1, 3), (1, 1, 2)], "i long, j long, v long"), 3, 2)
    b = Matrix(spark.createDataFrame([(0, 0, 7), (1, 4, 1), (1, 2, 2)], "i long, j long, v long"), 2, 5)
    large = Matrix(spark.createDataFrame([(0, 0, 2**40), (1, 0, 1)], "i long, j long, v long"), 2, 1)
    want = entries(products.matmul(a, b))
    monkeypatch.setattr(products, "PLACES", 0)
    monkeypatch.setattr(products, "ENTRIES", 0)
    assert entries(products.matmul(a, b)) == want
    with pytest.raises(Exception, match="overflow"):
        products.syrk(large).df.collect()
    nulls = Matrix(a.df.where("i = 0 and j = 0 or j is null"), 3, 2)
    assert entries(products.matmul(nulls, b)) == [(0, 0, 35)]


def test_kernel_of_gathered_products(monkeypatch):
    rng = np.random.default_rng(1)
    for trial in range(60):
        (rows, cols, inner), (n, m) = rng.integers(1, 60, 3), rng.integers(1, 300, 2)
        k, p, v = np.sort(rng.integers(0, inner, n)) - 20, rng.integers(0, rows, n), rng.integers(-9, 300, n)
        t, q, w = np.sort(rng.integers(0, inner, m)) - 20, rng.integers(0, cols, m), rng.integers(-(2**20), 2**20, m)
        monkeypatch.setattr(_gathered, "TERMS", int(rng.integers(1, 200)))
        monkeypatch.setattr(_gathered, "SPARSE", (0, 16, 10**6)[trial % 3])
        a, b, ones = np.zeros((rows, inner), int), np.zeros((inner, cols), int), np.zeros((rows, cols), int)
        np.add.at(a, (p, k + 20), v)
        np.add.at(b, (t + 20, q), w)
        stored = np.array([[np.isin(k[p == i], t[q == j]).any() for j in range(cols)] for i in range(rows)])
        got = np.zeros((rows, cols), int)
        for i, j, x in _gathered.multiplied(_gathered._gathered([_gathered.encoded(k, p, v)]), _gathered._gathered([_gathered.encoded(t, q, w)]), int(cols)):
            np.add.at(ones, (i, j), 1)
            got[i, j] = x
        assert (got == a @ b).all() and (ones == stored).all()


@pytest.mark.parametrize("square", [True, False])
def test_terms_of_even_keys_are_not_shuffled(spark, square):
    """Keys are drawn evenly, so blocks of rows hold one entry of an index: before, 2.8 bytes of shuffle were written for each term."""
    rows = spark.range(80_000).select(F.expr("xxhash64(id, 1) % 1500 + 1500").alias("i"), F.expr("pmod(xxhash64(id, 2), 1300)").alias("j"), F.expr("1 + id % 50").alias("v"))
    a = Matrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), 3000, 1300)
    terms = a.df.groupBy("j").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
    out = products.syrk(a) if square else products.matmul(a, views.transposed(a))
    moved = shuffled(spark, out.df)
    assert moved < 2 * terms
    got = out.df.agg(F.sum("v"), F.count("*"), F.countDistinct("i", "j")).first()
    met = a.df.groupBy("j").agg(F.sum("v").alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    assert got[0] == met and got[1] == got[2]
