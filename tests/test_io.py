"""Files, pictures and generators."""

import gzip
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matrel.functions import generators as G
from matrel.functions import scalar
from matrel.functions.accumulators import exact_sum, fused_sum
from matrel.operators import ndarray
from matrel.relation import matrix, need_field, vector
from matrel.sources import matrix_market as M
from matrel.sources import spy, text

FILE = """%%MatrixMarket matrix coordinate real symmetric
% a comment

3 3 4
1 1 2.5
2 1 -1
2 1 -1
3 3 4
"""


def one_part(folder):
    return next(folder.glob("part-*")).read_text()


def test_matrix_market(spark, tmp_path):
    (tmp_path / "a.mtx").write_text(FILE)
    (tmp_path / "a.mtx.gz").write_bytes(gzip.compress(FILE.encode()))
    want = np.array([[2.5, -2, 0], [-2, 0, 0], [0, 0, 4]])
    assert (M.mm_read(spark, str(tmp_path / "a.mtx")).to_numpy() == want).all()
    assert (M.mm_read(spark, str(tmp_path / "a.mtx.gz")).to_numpy() == want).all()
    last = want.copy()
    last[0, 1] = last[1, 0] = -1
    assert (M.mm_read_dense(spark, str(tmp_path / "a.mtx")).to_numpy() == last).all()


@pytest.mark.parametrize("head", ["%%MatrixMarket matrix array real general", "%%MatrixMarket matrix array real symmetric"])
def test_array_layout(spark, tmp_path, head):
    symmetric = head.endswith("symmetric")
    values = [1, 2, 3, 4, 5, 6] if symmetric else range(1, 10)
    (tmp_path / "a.mtx").write_text(head + "\n3 3\n" + "\n".join(map(str, values)) + "\n")
    want = np.array([[1, 2, 3], [2, 4, 5], [3, 5, 6]]) if symmetric else np.arange(1, 10).reshape(3, 3).T
    assert (M.mm_read(spark, str(tmp_path / "a.mtx")).to_numpy() == want).all()


@pytest.mark.parametrize("body", ["%%MatrixMarket matrix coordinate complex general\n1 1 1\n1 1 1\n", "nothing\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n3 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 2\n1 1 1\n", "%%MatrixMarket matrix coordinate real general\n2 2 1\n1 1 x\n"])
def test_bad_files(spark, tmp_path, body):
    (tmp_path / "a.mtx").write_text(body)
    with pytest.raises(M.MatrixMarketError):
        M.mm_read(spark, str(tmp_path / "a.mtx"))


def test_round_trips(spark, tmp_path):
    a = np.array([[1.5, 0, math.pi], [0, -2e-7, 0]])
    m = matrix(spark, a)
    for write, name in ((M.mm_write, "dense"), (M.mm_write_sparse, "sparse")):
        write(m, str(tmp_path / name))
        assert (M.mm_read(spark, str(tmp_path / name)).to_numpy() == a).all()
    text.write_dense(m, str(tmp_path / "text"))
    assert (text.read_dense(spark, str(tmp_path / "text")).to_numpy() == a).all()
    text.write_sparse(m, str(tmp_path / "triplets"))
    assert (text.read_sparse(spark, str(tmp_path / "triplets"), 2, 3).to_numpy() == a).all()
    assert one_part(tmp_path / "dense").startswith("%%MatrixMarket matrix array real general\n2 3\n")


def test_ragged_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1,2,3\n\n4\n5,6,7,8\n")
    assert (text.read_dense(spark, str(tmp_path / "a.txt")).to_numpy() == [[1, 2, 3], [4, 0, 0], [5, 6, 7]]).all()
    (tmp_path / "b.txt").write_text("\n")
    with pytest.raises(ValueError):
        text.read_dense(spark, str(tmp_path / "b.txt"))


def test_pictures(spark, tmp_path):
    m = G.laplacian_2d(spark, 8, 8)
    for f in (spy.spy, spy.spy_magnitude, spy.spy_density):
        f(m, str(tmp_path / "a.png"))
        assert (tmp_path / "a.png").read_bytes().startswith(b"\x89PNG")
    with pytest.raises(ValueError):
        spy.grid_shape(m.__class__(m.df, 0, 3))


def test_magic_and_friends(spark):
    for n in (3, 4, 5, 8):
        a = G.magic(spark, n).to_numpy()
        assert sorted(a.reshape(-1).tolist()) == list(range(1, n * n + 1))
        assert {*a.sum(0), *a.sum(1), np.trace(a), np.trace(a[::-1])} == {n * (n * n + 1) / 2}
    assert (G.magic(spark, 3).to_numpy() == [[8, 1, 6], [3, 5, 7], [4, 9, 2]]).all()
    with pytest.raises(ValueError):
        G.magic(spark, 6)
    assert np.allclose(np.linalg.eigvalsh(G.clement(spark, 6).to_numpy()), [-5, -3, -1, 1, 3, 5])
    assert np.allclose(np.linalg.eigvalsh(G.rosser(spark).to_numpy())[-2:], [1020, 1020.0490184299969])
    assert np.allclose(np.linalg.svd(G.randsvd(spark, 6, kappa=100.0).to_numpy())[1], G.make_sigma(6, 100.0))
    assert np.allclose(np.linalg.eigvalsh(G.randspd(spark, 5, 10.0).to_numpy()), G.make_sigma(5, 10.0)[::-1])
    with pytest.raises(ValueError):
        G.geomspace(spark, -1, 1)
    assert G.arange(spark, 0, 5, 0).df.count() == 0


def test_accumulators():
    a, b = np.array([1e16, 1.0, -1e16]), np.ones(3)
    assert exact_sum(a, b) == 1.0
    assert fused_sum(np.array([1.0]), np.array([2.0])) == 2.0


def test_ieee_results(spark):
    df = vector(spark, np.array([0.0, -1.0, float("nan"), 2.5, -2.5])).df
    r = [tuple(x) for x in df.orderBy("i").select(scalar.UNARY["log"](df["v"]).alias("l"), scalar.signum(df["v"]).alias("s"), scalar.round_half_away(df["v"]).alias("r")).collect()]
    assert r[0][0] == -math.inf and math.isnan(r[1][0]) and r[2][1] == 0.0 and (r[3][2], r[4][2]) == (3.0, -3.0)
    assert scalar.identity_of("min", "int") == 2**31 - 1


def test_integers_are_refused(spark):
    with pytest.raises(TypeError):
        need_field(matrix(spark, np.array([[1, 2], [3, 4]])))


def test_broadcasting_rules():
    assert ndarray.broadcast_shape((2, 1), (1, 3)) == (2, 3)
    assert ndarray.broadcast_shape((2,), (2, 3)) is None and ndarray.broadcast_shape((2, 3), (2, 4)) is None
    assert ndarray.strides((2, 3, 4)) == (12, 4, 1) and ndarray.strides((2, 3, 4), "F") == (1, 2, 6)


def test_numbers_as_a_stream_prints_them(spark):
    values = [0.0, 1.0, -1.5, 531.0, 123456.0, 1234567.0, 999999.5, 1e-4, 1.5e-5, 0.1, 1 / 3, 2 / 3 * 1e5, -1e20, 1e300, 100000.0, 1e6, 12345.678, float("nan"), float("inf"), -float("inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k long, v double")
    got = [r["x"] for r in df.select("k", text.general(F.col("v")).alias("x")).orderBy("k").collect()]
    assert got == [f"{v:g}" for v in values]
