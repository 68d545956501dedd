"""Eigenvalues by products only: power, Lanczos and Arnoldi iterations, shift and invert."""

from __future__ import annotations

import numpy as np

from matrel.solvers.operators import Csr, Function, choose

#: Which eigenvalues: by magnitude or by real part, the largest or the smallest.
WHICH = {"largest_magnitude": lambda w: -np.abs(w), "smallest_magnitude": np.abs, "largest_real": lambda w: -w.real, "smallest_real": lambda w: w.real}


def power_iteration(a, v0: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-10) -> tuple[float, np.ndarray, bool]:
    """(value, vector, converged): ends when ``|A v - l v| <= tol (|l| + tol)``; the value is the Rayleigh quotient of the vector before the one returned."""
    a = choose(a)
    v = np.ones(a.shape[0]) if v0 is None else np.asarray(v0, float)
    v = v / np.linalg.norm(v)
    value = 0.0
    for _ in range(max_iter):
        w = a.apply(v)
        value = float(v @ w)
        done = np.linalg.norm(w - value * v) <= tol * (abs(value) + tol)
        size = np.linalg.norm(w)
        if size == 0:
            return 0.0, v, True
        v = w / size
        if done:
            return value, v, True
    return value, v, False


def _basis(a, v0, m: int) -> tuple[np.ndarray, np.ndarray]:
    """An orthonormal Krylov basis (twice orthogonalized) and the projection of A on it."""
    n = a.shape[0]
    v = np.array([1 + i / n for i in range(n)]) if v0 is None else np.array(v0, float)
    size = np.linalg.norm(v)
    v = v / size if size else np.eye(n)[0]
    q, h = [v], np.zeros((m + 1, m))
    for j in range(m):
        w = a.apply(q[j])
        for _ in range(2):
            for i, u in enumerate(q):
                c = u @ w
                h[i, j] += c
                w = w - c * u
        h[j + 1, j] = np.linalg.norm(w)
        if h[j + 1, j] <= np.sqrt(np.finfo(float).eps) * max(1.0, np.abs(h[: j + 1, j]).max()):
            return np.stack(q, 1), h[: j + 1, : j + 1]
        q.append(w / h[j + 1, j])
    return np.stack(q[:m], 1), h[:m, :m]


def lanczos(a, k: int = 1, which: str = "largest_magnitude", subspace: int | None = None, v0=None) -> tuple[np.ndarray, np.ndarray]:
    """k extremal eigenpairs of a symmetric operator."""
    a = choose(a)
    m = min(a.shape[0], subspace or max(2 * k + 20, 20))
    q, h = _basis(a, v0, m)
    w, y = np.linalg.eigh((h + h.T) / 2)
    order = np.argsort(WHICH[which](w), kind="stable")[:k]
    return w[order], q @ y[:, order]


def arnoldi(a, k: int = 1, which: str = "largest_magnitude", subspace: int | None = None, v0=None) -> tuple[np.ndarray, np.ndarray]:
    """k extremal eigenpairs of a general operator, complex."""
    a = choose(a)
    m = min(a.shape[0], subspace or max(2 * k + 20, 20))
    q, h = _basis(a, v0, m)
    w, y = np.linalg.eig(h)
    order = np.argsort(WHICH[which](w), kind="stable")[:k]
    return w[order].astype(complex), q @ y[:, order]


def sparse_eigs(a, k: int = 1, which: str = "largest_magnitude", subspace: int | None = None):
    return arnoldi(a, k, which, subspace)


def shift_diagonal(a: Csr, sigma: float) -> Csr:
    """``A - sigma I``; missing diagonal entries appear."""
    n = min(a.shape)
    return Csr(*a.shape, np.concatenate([a.rows, np.arange(n)]), np.concatenate([a.idx, np.arange(n)]), np.concatenate([a.val, np.full(n, -sigma)]))


def shift_invert_operator(a: Csr, sigma: float) -> Function:
    """``(A - sigma I)^-1``, factored once."""
    from matrel.kernels.sparse import SparseLu

    lu = SparseLu(shift_diagonal(a, sigma))
    return Function(a.shape[0], lu.solve, lu.adjoint_solve)


def sparse_eigs_shift_invert(a: Csr, sigma: float, k: int = 1, subspace: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The k eigenpairs nearest ``sigma``: ``sigma + 1 / theta``."""
    theta, v = arnoldi(shift_invert_operator(a, sigma), k, "largest_magnitude", subspace)
    return sigma + 1 / theta, v
