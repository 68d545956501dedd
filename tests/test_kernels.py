"""Dense and sparse kernels by their invariants and against NumPy."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matrel.functions import wide as W
from matrel.kernels import dense as D
from matrel.kernels import ordering as O
from matrel.kernels import precond as P
from matrel.kernels import sparse as S
from matrel.solvers import eigen as E
from matrel.solvers import krylov as K
from matrel.solvers.iteration import Iteration
from matrel.solvers.multigrid import Multigrid
from matrel.solvers.operators import Csr

N = 30


def make(seed):
    rng = np.random.default_rng(seed)
    a = (rng.random((N, N)) < 0.12) * rng.normal(size=(N, N))
    a[np.arange(N), rng.permutation(N)] += 3
    return rng, a, rng.normal(size=N)


def spd(a):
    m = a @ a.T
    m[np.abs(m) < 0.05] = 0
    return (m + m.T) / 2 + np.eye(N) * N


@pytest.mark.parametrize("seed", range(6))
def test_sparse_solvers_agree(seed):
    _, a, b = make(seed)
    x, c = np.linalg.solve(a, b), Csr.from_dense(a)
    for f in (S.sparse_lu_solve, S.klu_solve, S.sparse_qr_solve, S.solve_refined):
        assert np.allclose(f(c, b), x, atol=1e-7), f
    lu = S.SparseLu(c)
    assert np.allclose(lu.adjoint_solve(b), np.linalg.solve(a.T, b))
    assert np.allclose(lu.refactor(Csr.from_dense(a * 1.3)).solve(b), x / 1.3)
    k = S.Klu(c)
    k.refactor(Csr.from_dense(a * 2))
    assert np.allclose(k.solve(b), x / 2)


@pytest.mark.parametrize("seed", range(4))
def test_sparse_symmetric(seed):
    _, a, b = make(seed)
    m = spd(a)
    c, x = Csr.from_dense(m), np.linalg.solve(m, b)
    for order in (None, O.amd, O.rcm, O.colamd):
        assert np.allclose(S.sparse_cholesky_solve(c, b, order), x)
        assert np.allclose(S.sparse_ldlt_solve(c, b, order), x)
    f = S.SparseCholesky(c, None)
    low = np.zeros((N, N))
    for k, (rows, values) in enumerate(f.factor()):
        low[rows, k] = values
    assert np.allclose(low @ low.T, m[np.ix_(f.p, f.p)])
    counts = O.column_counts(c.permuted(f.p, f.p))
    assert all(len(rows) <= n for (rows, _), n in zip(f.factor(), counts, strict=True))
    for kind, full in (("lower", low), ("lower_transpose", low.T)):
        assert np.allclose(S.LevelSchedule(f.factor(), kind).solve(b), np.linalg.solve(full, b))
    with pytest.raises(S.NotPositiveDefinite):
        S.sparse_cholesky_solve(Csr.from_dense(m - 2 * np.eye(N) * N * 3), b)


def test_sparse_triangular_solve():
    low = np.tril(make(1)[1]) + np.eye(N) * 4
    cols = S.columns_of(Csr.from_dense(low))
    b = np.zeros(N)
    b[[3, 17]] = 1, 2
    idx, val = S.sparse_lower_solve(cols, np.array([3, 17]), np.array([1.0, 2.0]))
    x = np.zeros(N)
    x[idx] = val
    assert np.allclose(x, np.linalg.solve(low, b))


def test_graph_algorithms():
    _, a, _ = make(2)
    c = Csr.from_dense(a)
    rows, cols, starts, singular = O.block_triangular_form(c)
    assert not singular
    b = c.permuted(rows, cols)
    block = np.searchsorted(starts, np.arange(N), side="right") - 1
    assert (block[b.rows] <= block[b.idx]).all() and np.abs(b.diagonal()).min() > 0
    a[:, 3] = 0
    assert O.block_triangular_form(Csr.from_dense(a))[3]
    chain = Csr.from_dense(np.eye(8) * 2 + np.eye(8, k=1) + np.eye(8, k=-1))
    assert O.elimination_tree(chain).tolist() == [1, 2, 3, 4, 5, 6, 7, -1]
    shuffled = chain.permuted(np.array([3, 0, 6, 1, 7, 2, 5, 4]), np.array([3, 0, 6, 1, 7, 2, 5, 4]))
    p = O.rcm(shuffled)
    assert O.bandwidth(shuffled.permuted(p, p)) == 1


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 9))
def test_dense_invariants(seed, n):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(size=(n, n)) + np.eye(n) * 3, rng.normal(size=n)
    lu, p, info = D.lu_factor(a)
    assert info == 0 and np.allclose(a @ D.lu_solve(lu, p, b), b) and np.allclose(a.T @ D.lu_adjoint_solve(lu, p, b), b)
    assert np.isclose(D.determinant(a), np.linalg.det(a))
    s = a + a.T
    ld, ipiv, _ = D.ldlt_bk_factor(s - 3 * np.eye(n))
    if np.linalg.cond(s - 3 * np.eye(n)) < 1e8:
        assert np.allclose((s - 3 * np.eye(n)) @ D.ldlt_bk_solve(ld, ipiv, b), b, atol=1e-6)
    t = rng.normal(size=(n + 3, n)) + 1j * rng.normal(size=(n + 3, n))
    qr, taus = D.qr_factor(t)
    q = D.qr_extract_q(qr, taus)
    assert np.allclose(q @ D.qr_extract_r(qr), t) and np.allclose(q.conj().T @ q, np.eye(n + 3))
    h = t @ t.conj().T + np.eye(n + 3)
    h[np.diag_indices(n + 3)] = h.diagonal().real
    low, info = D.cholesky_h_factor(h)
    assert info == 0 and np.allclose(low @ low.conj().T, h)
    w, v = D.eigen(a)
    assert np.allclose(a @ v, v * w) and np.allclose(np.linalg.norm(v, axis=0), 1)


def test_codes_and_refusals():
    assert D.lu_factor(np.zeros((2, 2)))[2] == 1
    assert D.cholesky_factor(np.diag([1.0, -1.0]))[1] == 2
    assert D.cholesky_h_factor(np.array([[1 + 1j, 0], [0, 1]]))[1] == D.NOT_HERMITIAN
    with pytest.raises(TypeError):
        D.lu_factor(np.array([[1, 2], [3, 4]]))
    with pytest.raises(TypeError):
        D.cholesky_factor(np.eye(2) * 1j)
    assert D.determinant(np.zeros((2, 3))) == 0 and D.determinant(np.zeros((0, 0))) == 1
    assert D.condition_number(np.diag([1.0, 0.0])) == float("inf") and D.inertia(np.diag([1.0, -2.0, 0.0])) == (1, 1, 1)


class Diagonal:
    def __init__(self, a):
        self.d = np.diag(a)

    def solve(self, b):
        return b / self.d

    adjoint_solve = solve


@pytest.mark.parametrize("name", sorted(K.SOLVERS))
@pytest.mark.parametrize("scaled", [False, True])
def test_krylov(name, scaled):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(40, 40)) * 0.3 + np.eye(40) * 6
    a = a + a.T if name in ("cg", "minres") else a
    b = rng.normal(size=40)
    it = Iteration(float(np.linalg.norm(b)), 300, 1e-10)
    x, code = K.SOLVERS[name](a, b, None, Diagonal(a) if scaled else None, it)
    assert code == 0 and np.abs(a @ x - b).max() < 1e-7
    assert K.SOLVERS[name](a, b, None, None, Iteration(float(np.linalg.norm(b)), 1, 1e-14))[1] == 1


def test_three_steps_are_enough():
    x, code = K.cg(np.array([[4.0, 1, 0], [1, 3, 1], [0, 1, 2]]), np.array([1.0, 2, 3]), it=(it := Iteration(np.sqrt(14), 10)))
    assert code == 0 and it.i <= 3


def test_preconditioners_are_adjoint():
    rng, a, b = make(3)
    m = spd(a)
    c, y = Csr.from_dense(m), rng.normal(size=N)
    for pc in (P.Ilu0(c), P.Ilut(c), P.Ic0(c), P.Ildl(c), P.Diagonal(c), P.Ssor(c, 1.2), P.BlockDiagonal(c, 7)):
        assert np.isclose(pc.solve(b) @ y, b @ pc.adjoint_solve(y)), pc
    assert np.allclose(P.Ilut(c, N, 0.0).solve(b), np.linalg.solve(m, b))
    assert np.allclose(P.sor(c, np.zeros(N), b), P.gauss_seidel(c, np.zeros(N), b))


def test_eigenvalues():
    _, a, _ = make(4)
    m = spd(a)
    c, w = Csr.from_dense(m), np.linalg.eigvalsh(m)
    assert np.allclose(E.lanczos(m, 3, "largest_real")[0], w[::-1][:3])
    assert np.isclose(E.power_iteration(m, max_iter=20_000)[0], w[-1], rtol=1e-6)
    near = w[np.argsort(np.abs(w - 40))][:2]
    assert np.allclose(np.sort(E.sparse_eigs_shift_invert(c, 40.0, 2)[0].real), np.sort(near))


def test_multigrid_needs_levels():
    with pytest.raises(ValueError):
        Multigrid([Csr.from_dense(np.eye(3))], [], [], None, None)


def test_supernodal_factors():
    from matrel.kernels import ordering, sparse, supernodal

    rng = np.random.default_rng(11)
    for n in (1, 5, 40):
        a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.2) + np.diag(rng.normal(size=n) + 1e-3)
        b = rng.normal(size=n)
        own = Csr.from_dense(a)
        if np.linalg.cond(a) < 1e8:
            lu = supernodal.SupernodalLu(own)
            assert np.allclose(a @ lu.solve(b), b, atol=1e-7)
            other = Csr(*own.shape, own.rows, own.idx, own.val * rng.uniform(0.9, 1.1, len(own.val)))
            again = lu.refactor(other)
            assert np.allclose(other @ again.solve(b), b, atol=1e-5)
            lu.refactor_in_place(other)
            assert (lu.solve(b) == again.solve(b)).all()
            zero = Csr(*own.shape, own.rows, own.idx, own.val * 0)
            with pytest.raises(np.linalg.LinAlgError):
                lu.refactor_in_place(zero)
            assert (lu.solve(b) == again.solve(b)).all()
        s = a + a.T + np.diag(np.full(n, 10.0))
        own = Csr.from_dense(s)
        ldlt, plain = supernodal.SupernodalLdlt(own), sparse.SparseLdlt(own)
        assert np.allclose(s @ ldlt.solve(b), b)
        assert np.allclose(ldlt.d, plain.d) and len(ldlt.panels) <= n
        assert np.allclose(ldlt.solve_refined(own, b), np.linalg.solve(s, b))
    with pytest.raises(np.linalg.LinAlgError):
        supernodal.SupernodalLdlt(Csr.from_dense(np.array([[0.0, 1.0], [1.0, 0.0]])))
    block = Csr.from_dense(np.ones((6, 6)) + 6 * np.eye(6))
    assert len(supernodal.SupernodalLdlt(block, None).panels) == 1 and len(supernodal.SupernodalLu(block, None).panels) == 1


def test_leaves_of_rows():
    from matrel.kernels import ordering

    rng = np.random.default_rng(12)
    a = (rng.random((25, 25)) < 0.1) | np.eye(25, dtype=bool)
    own = Csr.from_dense((a | a.T).astype(float))
    parent = ordering.elimination_tree(own)
    post = ordering.postorder(parent)
    own = own.permuted(post, post)
    parent = ordering.elimination_tree(own)
    # each row's subtree is the union of the paths from its leaves up to the row
    for i in range(25):
        nodes = set()
        for r, j, kind, up in ordering.row_leaves(own, parent):
            if r == i:
                while j != i and j >= 0:
                    nodes.add(j)
                    j = int(parent[j])
        assert sorted(nodes) == ordering.row_pattern(own, parent, i)


def test_sparse_accumulator():
    from matrel.kernels.sparse import SparseAccumulator

    own = SparseAccumulator(8)
    own.scatter([3, 3, 5], [1.0, 2.0, 4.0])
    assert (own[3], own[5], own[0], own.nnz()) == (3.0, 4.0, 0.0, 2)
    own.clear()
    own.store(5, 9.0)
    own.scatter(5, 1.0)
    assert (own[5], own[3], own.is_set(3), own.indices().tolist()) == (10.0, 0.0, False, [5])


def test_wide_elements():
    rng = np.random.default_rng(5)
    jordan = np.diag(np.ones(5), 1) + 2 * np.eye(6)
    turned = np.roll(np.eye(6), 1, axis=0)
    for a in (rng.integers(0, 10**9, (6, 6)), jordan, turned, np.zeros((6, 6)), np.full((6, 6), 7.0), rng.integers(-9, 9, (6, 6)), np.array([[5.0]])):
        exact = np.array([[int(x) for x in row] for row in a], object)
        both = exact + exact.T
        with W.digits():
            for w, m in ((D.eigenvalue(W.wide(a)), exact), (D.eigenvalue_symmetric(W.wide(both)), both)):
                powers = [m, m @ m, m @ m @ m]
                assert [int(W.whole((w**k).sum())) for k in (1, 2, 3)] == [np.trace(p) for p in powers]
            assert int(W.whole((D.singular_values(W.wide(a)) ** 2).sum())) == (exact**2).sum()
    assert np.allclose(D.singular_values(W.wide(jordan)).astype(float), D.singular_values(jordan))
