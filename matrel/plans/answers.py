"""Queries of kernels and solvers whose answers SQL knows: factors are multiplied again, systems are made from known solutions, spectra have closed forms.

Everything is returned as whole numbers (scaled and rounded), so a kernel that is wrong shows in the rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matrel.functions import generators as gen
from matrel.functions.wide import digits, wide, whole
from matrel.kernels import dense, grouped, ordering, precond, sparse, supernodal
from matrel.operators import products
from matrel.plans import fixtures as fx
from matrel.relation import Matrix, Vector
from matrel.solvers import eigen, krylov
from matrel.solvers.iteration import CyclicIteration, Iteration, NoisyIteration
from matrel.solvers.operators import Csr, to_csr

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, oracle: str) -> None:
    QUERIES[name], ORACLE_SQL[name] = query, oracle


# Dense kernels: a matrix of 6 x 6 for each of 50 groups of orders, with a strong diagonal

N, SHIFT = 6, 100_000


def _small(s: SparkSession, sf: str) -> DataFrame:
    rows = fx.table(s, sf, "lineitem").select((F.col("l_orderkey") % 50).alias("id"), (F.col("l_partkey") % N).alias("i"), (F.col("l_suppkey") % N).alias("j"), F.col("l_quantity").cast("double").alias("v"))
    eye = s.range(50 * N).select(F.expr(f"id div {N}").alias("id"), (F.col("id") % N).alias("i"), (F.col("id") % N).alias("j"), F.lit(float(SHIFT)).alias("v"))
    return rows.groupBy("id", "i", "j").agg(F.sum("v").alias("v")).unionByName(eye).groupBy("id", "i", "j").agg(F.sum("v").alias("v"))


_B = f"(SELECT l_orderkey % 50 AS id, l_partkey % {N} AS i, l_suppkey % {N} AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2, 3)"
#: Without the diagonal's shift, all places; with it; the sum of the latter and its transpose.
_B = f"(SELECT g.id, t.i, s.j, CAST(coalesce(b.v, 0) AS BIGINT) AS v FROM range(50) g(id) CROSS JOIN range({N}) t(i) CROSS JOIN range({N}) s(j) LEFT JOIN {_B} b ON b.id = g.id AND b.i = t.i AND b.j = s.j)"
_A = f"(SELECT id, i, j, v + CASE WHEN i = j THEN {SHIFT} ELSE 0 END AS v FROM {_B})"
_S = f"(SELECT x.id, x.i, x.j, x.v + y.v AS v FROM {_A} x JOIN {_A} y ON x.id = y.id AND x.i = y.j AND x.j = y.i)"
_T = f"(SELECT x.id, x.i, x.j, x.v + y.v AS v FROM {_B} x JOIN {_B} y ON x.id = y.id AND x.i = y.j AND x.j = y.i)"
_elements = lambda table: f"SELECT id, i, j, CAST(v AS BIGINT) AS v FROM {table}"


def _grouped(kernel: Callable[[np.ndarray], np.ndarray], scale: float = 1.0) -> Query:
    def run(s: SparkSession, sf: str) -> DataFrame:
        out = grouped.map_elements(_small(s, sf), N, N, lambda a: np.round(np.real(kernel(a)) * scale))
        return out.select("id", "i", "j", F.col("v").cast("bigint").alias("v"))

    return run


def _grouped_wide(kernel: Callable[[np.ndarray], list]) -> Query:
    """A column of whole numbers by a kernel over wide elements: they may be larger than the 2**53 up to which doubles are whole."""

    def numbers(a: np.ndarray) -> np.ndarray:
        with digits():
            return np.array([whole(x) for x in kernel(a)], object)[:, None]

    def run(s: SparkSession, sf: str) -> DataFrame:
        return fx.whole(grouped.map_elements(_small(s, sf), N, N, numbers, result="decimal(38,0)").select("id", "i", "j", "v"))

    return run


X = np.arange(1.0, N + 1)
Z = X + 1j * X[::-1]
_shifted = lambda a: a - SHIFT * np.eye(N)
_sum = lambda a: a + a.T
_herm = lambda a: a + a.T + 1j * (a - a.T)


def _column(x: np.ndarray) -> np.ndarray:
    """Real and imaginary parts as columns."""
    return np.stack([x.real, x.imag], 1) if np.iscomplexobj(x) else x[:, None]


def _lu_again(a):
    lu, pivots, _ = dense.lu_factor(a)
    out = (np.tril(lu, -1) + np.eye(N)) @ np.triu(lu)
    for k in range(N - 1, -1, -1):
        out[[k, pivots[k]]] = out[[pivots[k], k]]
    return out


def _qr_again(a):
    qr, t = dense.qr_factor(a)
    return dense.qr_extract_q(qr, t) @ dense.qr_extract_r(qr)


def _lq_again(a):
    lq, t = dense.lq_factor(a)
    return dense.lq_extract_l(lq) @ dense.lq_extract_q(lq, t)


def _cholesky_again(a):
    low = np.tril(dense.cholesky_factor(_sum(a))[0])
    return low @ low.T


def _ldlt_again(a):
    ld = dense.ldlt_factor(_sum(a))[0]
    low = np.tril(ld, -1) + np.eye(N)
    return low @ np.diag(np.diag(ld)) @ low.T


def _hermitian_again(a):
    low = np.tril(dense.cholesky_h_factor(_herm(a))[0])
    return (low @ low.conj().T).imag


def _ldlt_h_again(a):
    ld = dense.ldlt_h_factor(_herm(a))[0]
    low = np.tril(ld, -1) + np.eye(N)
    return (low @ np.diag(np.diag(ld)) @ low.conj().T).imag


def _svd_again(a):
    u, s, v = dense.svd(a)
    return u @ s @ v.T


def _eigen_again(a):
    w, v = dense.eigen(a)
    return v @ np.diag(w) @ np.linalg.inv(v)


def _eigen_symmetric_again(a):
    w, v = dense.eigen_symmetric(_sum(a))
    return v @ np.diag(w) @ v.T


for _name, _kernel, _table in (
    ("lu", _lu_again, _A),
    ("qr", _qr_again, _A),
    ("lq", _lq_again, _A),
    ("inverse", lambda a: dense.inv(dense.inv(a)), _A),
    ("svd", _svd_again, _A),
    ("eigen", _eigen_again, _A),
    ("cholesky", _cholesky_again, _S),
    ("ldlt", _ldlt_again, _S),
    ("eigen_symmetric", _eigen_symmetric_again, _S),
):
    add(f"grouped_{_name}", _grouped(_kernel), _elements(_table))
_skew = f"SELECT x.id, x.i, x.j, CAST(x.v - y.v AS BIGINT) AS v FROM {_B} x JOIN {_B} y ON x.id = y.id AND x.i = y.j AND x.j = y.i"
add("grouped_cholesky_h", _grouped(_hermitian_again), _skew)
add("grouped_ldlt_h", _grouped(_ldlt_h_again), _skew)

# solutions are 1 to 6, in millionths
_x = f"SELECT g.id, t.i, CAST(0 AS BIGINT) AS j, CAST(1000000 * (t.i + 1) AS BIGINT) AS v FROM range(50) g(id) CROSS JOIN range({N}) t(i)"
_z = f"SELECT g.id, t.i, s.j, CAST(1000000 * CASE s.j WHEN 0 THEN t.i + 1 ELSE {N} - t.i END AS BIGINT) AS v FROM range(50) g(id) CROSS JOIN range({N}) t(i) CROSS JOIN range(2) s(j)"
_mixed = lambda a: _sum(_shifted(a))  # noqa: E731  neither positive nor negative definite
for _name, _kernel in {
    "lu_solve": lambda a: dense.lu_solve(*dense.lu_factor(a)[:2], a @ X),
    "lu_adjoint": lambda a: dense.lu_adjoint_solve(*dense.lu_factor(a)[:2], a.T @ X),
    "lu_apply": lambda a: dense.lu_apply(a, a @ X),
    "lu_refine": lambda a: dense.lu_iterative_refine(a, a @ X),
    "inverse_apply": lambda a: dense.inv(a) @ (a @ X),
    "cholesky_solve": lambda a: dense.cholesky_solve(dense.cholesky_factor(_sum(a))[0], _sum(a) @ X),
    "ldlt_solve": lambda a: dense.ldlt_solve(dense.ldlt_factor(_sum(a))[0], _sum(a) @ X),
    "ldlt_bk": lambda a: dense.ldlt_bk_solve(*dense.ldlt_bk_factor(_mixed(a))[:2], _mixed(a) @ X),
    "qr_solve": lambda a: dense.qr_solve(a, a @ X),
    "trsv": lambda a: dense.trsv(a, np.tril(a) @ X, lower=True),
    "lower_trisolve": lambda a: dense.lower_trisolve(a, (np.tril(a, -1) + np.eye(N)) @ X, unit=True),
    "upper_trisolve": lambda a: dense.upper_trisolve(a, np.triu(a) @ X),
    "trsm": lambda a: dense.trsm(a, np.triu(a) @ np.outer(X, X))[:, 0],
    "solve_lu": lambda a: sparse.solve(a, a @ X),
    "solve_qr": lambda a: sparse.solve(a, a @ X, "qr"),
    "solve_cholesky": lambda a: sparse.solve(_sum(a), _sum(a) @ X, "cholesky"),
}.items():
    add(f"grouped_{_name}", _grouped((lambda k: lambda a: _column(k(a)))(_kernel), 1e6), _x)
for _name, _kernel in {
    "cholesky_h_solve": lambda a: dense.cholesky_h_solve(dense.cholesky_h_factor(_herm(a))[0], _herm(a) @ Z),
    "ldlt_h_solve": lambda a: dense.ldlt_h_solve(dense.ldlt_h_factor(_herm(a))[0], _herm(a) @ Z),
}.items():
    add(f"grouped_{_name}", _grouped((lambda k: lambda a: _column(k(a)))(_kernel), 1e6), _z)


def _moments(h: np.ndarray, zero: np.ndarray) -> list:
    """Traces of three powers, and how many entries are over what rounding leaves where there should be none."""
    return [np.trace(h), np.trace(h @ h), np.trace(h @ h @ h), int((np.abs(zero) * 10**9 > np.abs(h).max()).sum())]


def _sums(w: np.ndarray) -> list:
    return [w.sum(), (w**2).sum(), (w**3).sum(), 0]


_traces = lambda t: (
    f"SELECT id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(sum(v) AS BIGINT) AS v FROM {t} WHERE i = j GROUP BY id"
    f" UNION ALL SELECT x.id, 1, 0, CAST(sum(x.v * y.v) AS BIGINT) FROM {t} x JOIN {t} y ON x.id = y.id AND x.j = y.i AND x.i = y.j GROUP BY x.id"
    f" UNION ALL SELECT x.id, 2, 0, CAST(sum(x.v * y.v * z.v) AS BIGINT) FROM {t} x JOIN {t} y ON x.id = y.id AND x.j = y.i JOIN {t} z ON y.id = z.id AND y.j = z.i AND z.j = x.i GROUP BY x.id"
    " UNION ALL SELECT id, 3, 0, 0 FROM range(50) g(id)"
)
for _name, _kernel, _table in (
    ("hessenberg", lambda a: (lambda h: _moments(h, np.tril(h, -2)))(dense.hessenberg(wide(_shifted(a)))), _B),
    ("tridiagonal", lambda a: (lambda h: _moments(h, np.tril(h, -2) + np.triu(h, 2)))(_whole(dense.tridiagonalize(wide(_sum(_shifted(a)))))), _T),
    ("eigenvalue", lambda a: _sums(dense.eigenvalue(wide(_shifted(a)))), _B),
    ("eigenvalue_symmetric", lambda a: _sums(dense.eigenvalue_symmetric(wide(_sum(_shifted(a))))), _T),
):
    add(f"grouped_{_name}", _grouped_wide(_kernel), _traces(_table))


def _whole(h: np.ndarray) -> np.ndarray:
    """A tridiagonal result as it stands."""
    return h


def _row(kernel: Callable[[np.ndarray], list]) -> Query:
    return _grouped(lambda a: np.array(kernel(a), float)[:, None])


def _rows(*values: str, table: str = "range(50) g(id)", group: str = "") -> str:
    return " UNION ALL ".join(f"SELECT id, CAST({k} AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST({v} AS BIGINT) AS v FROM {table} {group}" for k, v in enumerate(values))


def _signed(a: np.ndarray) -> np.ndarray:
    """Symmetric with as many positive as negative eigenvalues: a congruence keeps the signs."""
    low = np.tril(a / SHIFT, -1) + np.eye(N)
    return low @ np.diag(a.sum(axis=1) * np.where(np.arange(N) % 2, -1, 1)) @ low.T


_first = lambda a: np.outer(a[:, 0], a[:, 0])  # noqa: E731  of rank 1
add("grouped_rank", _row(lambda a: [dense.numerical_rank(a), dense.nullity(a), dense.numerical_rank(_first(a)), dense.nullity(_first(a))]), _rows(f"{N}", "0", "1", f"{N - 1}"))
add("grouped_inertia", _row(lambda a: [*dense.inertia(_signed(a)), *dense.inertia(_first(a))]), _rows("3", "3", "0", "1", "0", f"{N - 1}"))
add(
    "grouped_is_spd",
    _row(lambda a: [f(x) for f in (dense.is_spd, dense.is_positive_definite, dense.is_singular, dense.is_nonsingular, dense.is_indefinite) for x in (_sum(a), -_sum(a), _signed(a), np.zeros((N, N)))]),
    _rows(*"1000" "1000" "0001" "1110" "0010"),
)
add("grouped_singular_values", _row(lambda a: [(dense.singular_values(_shifted(a)) ** 2).sum()]), _rows("sum(v * v)", table=_B, group="GROUP BY id"))
add("grouped_spectral_radius", _row(lambda a: [dense.spectral_radius(_first(_shifted(a)))]), _rows("sum(v * v)", table=f"(SELECT * FROM {_B} WHERE j = 0)", group="GROUP BY id"))
_row_sums = f"(SELECT id, CAST(max(v) AS DOUBLE) AS high, CAST(min(v) AS DOUBLE) AS low FROM (SELECT id, i, sum(v) AS v FROM {_A} GROUP BY 1, 2) GROUP BY id)"
add("grouped_condition", _grouped_wide(lambda a: (lambda d: [10**6 * dense.condition_number(d), 10**6 * dense.rcond(d)])(wide(np.diag(a.sum(axis=1))))), _rows("round(1e6 * high / low)", "round(1e6 * low / high)", table=_row_sums))
_at = lambda i, j: f"sum(CASE WHEN i = {i} AND j = {j} THEN v END)"
add(
    "grouped_determinant",
    _row(lambda a: [dense.determinant(_shifted(a)[:3, :3]).real]),
    _rows("a * (e * i_ - f * h) - b * (d * i_ - f * g) + c * (d * h - e * g)", table="(SELECT id, " + ", ".join(f"{_at(k // 3, k % 3)} AS {n}" for k, n in enumerate(("a", "b", "c", "d", "e", "f", "g", "h", "i_"))) + f" FROM {_B} GROUP BY id)"),
)


def _rotated(a: np.ndarray) -> list:
    """The first two entries of each column turned onto the first."""
    out = []
    for x, y in _shifted(a)[:2].T:
        pair = np.array([x, y])
        dense.apply_rotation(pair, 0, *dense.givens(x, y))
        out += [1000 * pair[0], 1000 * pair[1]]
    return out


_pairs = f"(SELECT id, j, CAST(sum(v * v) AS DOUBLE) AS s FROM {_B} WHERE i < 2 GROUP BY 1, 2)"
add("grouped_rotation", _row(_rotated), f"SELECT id, CAST(2 * j AS BIGINT) AS i, CAST(0 AS BIGINT) AS j, CAST(round(1000 * sqrt(s)) AS BIGINT) AS v FROM {_pairs} UNION ALL SELECT id, 2 * j + 1, 0, 0 FROM {_pairs}")

# Systems with a known solution: sums of parts' sizes


def _truth(s: SparkSession, sf: str, n: int) -> Vector:
    rows = fx.table(s, sf, "part").groupBy((F.col("p_partkey") % n).alias("i")).agg(F.sum("p_size").cast("double").alias("v"))
    return Vector(rows, n).dense()


_known = lambda n, more="": f"SELECT t.i, CAST(1000 * coalesce(p.v, 0) AS BIGINT) AS v{more} FROM range({n}) t(i) LEFT JOIN (SELECT p_partkey % {n} AS i, sum(CAST(p_size AS BIGINT)) AS v FROM part GROUP BY 1) p ON p.i = t.i"


def _numbers(s: SparkSession, x: np.ndarray, **more: int) -> DataFrame:
    """Rows ``i, v`` in thousandths."""
    return s.createDataFrame(pd.DataFrame({"i": np.arange(len(x)), "v": np.round(1000 * np.real(x)).astype(np.int64), **{k: np.int64(v) for k, v in more.items()}}))


def _krylov(name: str, control: type = Iteration) -> Query:
    def run(s: SparkSession, sf: str) -> DataFrame:
        a = gen.laplacian_2d(s, 20, 20)
        b = products.mult(a, _truth(s, sf, 400)).to_numpy()
        x, code = krylov.SOLVERS[name](a, b, it=control(float(np.linalg.norm(b)), 2000, 1e-12))
        return _numbers(s, x, code=code)

    return run


_code = ", CAST(0 AS BIGINT) AS code"
for _name in krylov.SOLVERS:
    add(f"krylov_{_name}", _krylov(_name), _known(400, _code))
add("krylov_cyclic_iteration", _krylov("cg", CyclicIteration), _known(400, _code))
add("krylov_noisy_iteration", _krylov("cg", NoisyIteration), _known(400, _code))


def _grid(s: SparkSession, sf: str) -> tuple[Csr, np.ndarray]:
    a = gen.laplacian_2d(s, 12, 12)
    return to_csr(a), products.mult(a, _truth(s, sf, 144)).to_numpy()


def _direct(f: Callable[[Csr, np.ndarray], np.ndarray]) -> Query:
    return lambda s, sf: _numbers(s, f(*_grid(s, sf)))


def _by_levels(kind: str, transposed: bool = False) -> Callable[[Csr, np.ndarray], np.ndarray]:
    """A triangular solve by levels of the factor, the other half of the solution by the plain solves."""

    def f(a: Csr, b: np.ndarray) -> np.ndarray:
        own = sparse.SparseLdlt(a) if "unit" in kind else sparse.SparseCholesky(a)
        low = own.low if "unit" in kind else own.factor()
        unit = "unit" in kind
        y = np.asarray(b, float)[own.p]
        forward = sparse.LevelSchedule(low, kind).solve if "transpose" not in kind and kind != "upper" else lambda z: sparse.dense_lower_solve(low, z, unit)
        y = forward(y)
        y = y / own.d if unit else y
        if "transpose" in kind:
            y = sparse.LevelSchedule(low, kind).solve(y)
        elif kind == "upper":
            y = sparse.LevelSchedule(sparse.columns_of(_rows_csr(low)), kind).solve(y)
        else:
            y = sparse.dense_lower_transpose_solve(low, y, unit)
        out = np.empty(len(y))
        out[own.p] = y
        return out

    return f


def _rows_csr(columns: sparse.Columns) -> Csr:
    """The transpose of a matrix given by columns."""
    n = len(columns)
    return Csr(n, n, np.repeat(np.arange(n), [len(c[0]) for c in columns]), np.concatenate([c[0] for c in columns]), np.concatenate([c[1] for c in columns]))


def _refactored(kind, in_place: bool = False):
    """Factored for another matrix of the same pattern, then for this one."""

    def f(a: Csr, b: np.ndarray) -> np.ndarray:
        own = kind(Csr(*a.shape, a.rows, a.idx, a.val * 2 + (a.rows == a.idx)))
        if in_place:
            own.refactor_in_place(a)
        else:
            own = own.refactor(a) or own
        return own.solve(b)

    return f


def _sparse_right(a: Csr, b: np.ndarray) -> np.ndarray:
    """Forward by the reach of the sparse right side, backward by the dense upper solve."""
    own = sparse.SparseCholesky(a)
    low = own.factor()
    y = np.asarray(b, float)[own.p]
    at = np.flatnonzero(y)
    idx, val = sparse.sparse_lower_solve(low, at, y[at])
    z = np.zeros(len(y))
    z[idx] = val
    out = np.empty(len(y))
    out[own.p] = sparse.dense_upper_solve(sparse.columns_of(_rows_csr(low)), z)
    return out


for _name, _f in {
    "cholesky": sparse.sparse_cholesky_solve,
    "ldlt": sparse.sparse_ldlt_solve,
    "lu": sparse.sparse_lu_solve,
    "qr": sparse.sparse_qr_solve,
    "klu": sparse.klu_solve,
    "refined": sparse.solve_refined,
    "lu_refactor": _refactored(sparse.SparseLu),
    "lu_refactor_in_place": _refactored(sparse.SparseLu, True),
    "klu_refactor": _refactored(sparse.Klu),
    "lower_solve": _sparse_right,
    "supernodal_ldlt": lambda a, b: supernodal.SupernodalLdlt(a).solve(b),
    "supernodal_ldlt_refined": lambda a, b: supernodal.SupernodalLdlt(a).solve_refined(a, b),
    "supernodal_lu": lambda a, b: supernodal.SupernodalLu(a).solve(b),
    "supernodal_lu_refined": lambda a, b: supernodal.SupernodalLu(a).solve_refined(a, b),
    "supernodal_lu_refactor": _refactored(supernodal.SupernodalLu),
    "supernodal_lu_refactor_in_place": _refactored(supernodal.SupernodalLu, True),
    "solve": sparse.solve,
    "solve_cholesky": lambda a, b: sparse.solve(a, b, "cholesky"),
    "solve_qr": lambda a, b: sparse.solve(a, b, "qr"),
    **{f"level_scheduled_{k}": _by_levels(k) for k in ("lower", "lower_transpose", "upper", "unit_lower", "unit_lower_transpose")},
    **{f"ordered_{f.__name__}": (lambda f: lambda a, b: sparse.sparse_cholesky_solve(a, b, f))(f) for f in (ordering.natural, ordering.rcm, ordering.amd, ordering.colamd)},
}.items():
    add(f"sparse_{_name}", _direct(_f), _known(144))


def _preconditioned(make) -> Callable[[Csr, np.ndarray], np.ndarray]:
    return lambda a, b: krylov.cg(a, b, m=make(a), it=Iteration(float(np.linalg.norm(b)), 500, 1e-13))[0]


for _name, _make in {"diagonal": precond.Diagonal, "block_diagonal": lambda a: precond.BlockDiagonal(a, 12), "ic0": precond.Ic0, "ildl": precond.Ildl, "ilu0": precond.Ilu0, "ilut": precond.Ilut, "ssor": precond.Ssor}.items():
    add(f"preconditioned_{_name}", _direct(_preconditioned(_make)), _known(144))


def _smoothed(f) -> Query:
    """Sweeps until nothing is left to smooth; a chain of 40 points."""

    def run(s: SparkSession, sf: str) -> DataFrame:
        a = gen.laplacian_1d(s, 20)
        b = products.mult(a, _truth(s, sf, 20)).to_numpy()
        own, x = to_csr(a), np.zeros(20)
        for _ in range(2500):
            new = f(own, x, b)
            if np.abs(new - x).max() < 1e-9:
                break
            x = new
        return _numbers(s, x)

    return run


for _name, _f in {"jacobi": precond.jacobi, "gauss_seidel": precond.gauss_seidel, "backward_gauss_seidel": precond.backward_gauss_seidel, "symmetric_gauss_seidel": precond.symmetric_gauss_seidel, "sor": lambda a, x, b: precond.sor(a, x, b, 1.2), "backward_sor": lambda a, x, b: precond.backward_sor(a, x, b, 1.2), "symmetric_sor": lambda a, x, b: precond.symmetric_sor(a, x, b, 1.2)}.items():
    add(f"smoother_{_name}", _smoothed(_f), _known(20))


def _multigrid(s: SparkSession, sf: str) -> DataFrame:
    """V-cycles, W-cycles and conjugate gradients preconditioned by one V-cycle, all to the known solution."""
    from matrel.solvers import multigrid as mg

    levels, down, up = [gen.laplacian_1d(s, 63)], [], []
    for n in (63, 31):
        r, p = mg.make_restriction_1d(s, n), mg.make_prolongation_1d(s, (n - 1) // 2)
        levels.append(mg.galerkin(r, levels[-1], p))
        down.append(r)
        up.append(p)
    m = mg.Multigrid.from_relations(levels, down, up, lambda a: lambda x, b: precond.symmetric_gauss_seidel(a, x, b), lambda a: lambda b: sparse.sparse_lu_solve(a, b))
    b = products.mult(levels[0], _truth(s, sf, 63)).to_numpy()
    x, y = np.zeros(63), np.zeros(63)
    for _ in range(25):
        x, y = m.vcycle(x, b), m.wcycle(y, b)
    z = krylov.cg(m.levels[0], b, m=m, it=Iteration(float(np.linalg.norm(b)), 200, 1e-13))[0]
    return _numbers(s, np.concatenate([x, y, z]))


add("multigrid", _multigrid, "SELECT 63 * g.k + t.i AS i, t.v FROM range(3) g(k) CROSS JOIN (" + _known(63) + ") t")

# Spectra in closed form


def _power(s: SparkSession, sf: str) -> DataFrame:
    """The one eigenvalue of ``u u^T`` that isn't zero."""
    u = fx.short(s, sf).df.select("i", F.col("v").cast("double").alias("v"))
    a = Matrix(u.crossJoin(u.select(F.col("i").alias("j"), F.col("v").alias("w"))).select("i", "j", (F.col("v") * F.col("w")).alias("v")), 48, 48)
    value, _, done = eigen.power_iteration(a, max_iter=500, tol=1e-12)
    return s.createDataFrame([(int(round(value)), int(done))], "v long, done long")


add("power_iteration", _power, "WITH u AS (" + fx.SQL["u"] + ") SELECT CAST(sum(v * v) AS BIGINT) AS v, CAST(1 AS BIGINT) AS done FROM u")


def _spectrum(f: Callable[[Csr], np.ndarray]) -> Query:
    def run(s: SparkSession, sf: str) -> DataFrame:
        w = np.real(f(to_csr(gen.laplacian_1d(s, 40))))
        return s.createDataFrame(pd.DataFrame({"k": np.arange(len(w)), "v": np.round(w * 1e6).astype(np.int64)}))

    return run


_chain = lambda n, k: f"SELECT k, CAST(round(1000000 * (2 - 2 * cos(pi() * ({k}) / 41))) AS BIGINT) AS v FROM range({n}) t(k)"
add("lanczos", _spectrum(lambda a: eigen.lanczos(a, 3, "largest_real", 40)[0]), _chain(3, "40 - k"))
add("arnoldi", _spectrum(lambda a: eigen.arnoldi(a, 2, "largest_magnitude", 40)[0]), _chain(2, "40 - k"))
add("sparse_eigs", _spectrum(lambda a: eigen.sparse_eigs(a, 2, "largest_magnitude", 40)[0]), _chain(2, "40 - k"))
add("shift_invert", _spectrum(lambda a: eigen.sparse_eigs_shift_invert(a, 0.0, 2, 40)[0]), _chain(2, "k + 1"))


def _made(make: Callable[[SparkSession], Matrix], symmetric: bool = False) -> Query:
    """The spectrum that a generator was asked for."""

    def run(s: SparkSession, sf: str) -> DataFrame:
        a = make(s).to_numpy()
        w = np.linalg.eigvalsh(a)[::-1] if symmetric else np.linalg.svd(a, compute_uv=False)
        return s.createDataFrame(pd.DataFrame({"k": np.arange(len(w)), "v": np.round(w * 1e6).astype(np.int64)}))

    return run


_values = lambda n, v: f"SELECT k, CAST(round(1000000 * ({v})) AS BIGINT) AS v FROM range({n}) t(k)"
add("randorth", _made(lambda s: gen.randorth(s, 12, 5)), _values(12, "1"))
add("randsvd", _made(lambda s: gen.randsvd(s, 12, 8, 100.0)), _values(8, "pow(100.0::DOUBLE, -k / 7.0::DOUBLE)"))
add("randsvd_given", _made(lambda s: gen.randsvd(s, 6, sigma=[6.0, 5.0, 4.0, 3.0, 2.0, 1.0])), _values(6, "6 - k"))
add("randsym", _made(lambda s: gen.randsym(s, [5.0, 3.0, 1.0, -1.0, -3.0]), True), _values(5, "5 - 2 * k"))
add("randspd", _made(lambda s: gen.randspd(s, 9, 50.0), True), _values(9, "pow(50.0::DOUBLE, -k / 8.0::DOUBLE)"))
add(
    "make_sigma",
    lambda s, sf: s.createDataFrame([(m, k, int(round(v * 1e6))) for m in range(1, 5) for k, v in enumerate(gen.make_sigma(5, 100.0, m))], "mode long, k long, v long"),
    "SELECT m AS mode, k, CAST(round(1000000 * CASE m WHEN 1 THEN CASE WHEN k = 0 THEN 1 ELSE 0.01 END WHEN 2 THEN CASE WHEN k = 4 THEN 0.01 ELSE 1 END WHEN 3 THEN pow(0.01::DOUBLE, k / 4.0::DOUBLE) ELSE 1 - 0.99::DOUBLE * k / 4 END) AS BIGINT) AS v FROM range(1, 5) a(m), range(5) b(k)",
)

# Orderings and symbolic analysis on patterns whose answers are plain: a chain, a star (arrow to the last) and a full one (arrow from the first)

_SIZE = 40


def _patterns() -> dict[str, Csr]:
    n, k = _SIZE, np.arange(_SIZE - 1)
    pairs = {"chain": (k + 1, k), "star": (np.full(n - 1, n - 1), k), "full": (k + 1, np.zeros(n - 1, int))}
    diagonal = np.arange(n)
    return {name: Csr(n, n, np.concatenate([diagonal, i, j]), np.concatenate([diagonal, j, i]), np.concatenate([np.full(n, 100.0), np.ones(2 * n - 2)])) for name, (i, j) in pairs.items()}


def _analysed(f: Callable[[Csr], np.ndarray | list]) -> Query:
    def run(s: SparkSession, sf: str) -> DataFrame:
        rows = [(name, k, int(v)) for name, a in _patterns().items() for k, v in enumerate(f(a))]
        return s.createDataFrame(rows, "name string, k long, v long")

    return run


_cases = lambda chain, star, full, n=_SIZE: " UNION ALL ".join(f"SELECT '{name}' AS name, k, CAST({v} AS BIGINT) AS v FROM range({n}) t(k)" for name, v in (("chain", chain), ("star", star), ("full", full)))
_last = _SIZE - 1
_up = f"CASE WHEN k = {_last} THEN -1 ELSE k + 1 END"
_to_last = f"CASE WHEN k = {_last} THEN -1 ELSE {_last} END"
_two = f"CASE WHEN k = {_last} THEN 1 ELSE 2 END"
add("elimination_tree", _analysed(ordering.elimination_tree), _cases(_up, _to_last, _up))
add("column_counts", _analysed(ordering.column_counts), _cases(_two, _two, f"{_SIZE} - k"))
add("total_nnz", _analysed(lambda a: [ordering.total_nnz(ordering.column_counts(a))]), _cases(f"{2 * _SIZE - 1}", f"{2 * _SIZE - 1}", f"{_SIZE * (_SIZE + 1) // 2}", 1))
add("tree_postorder", _analysed(lambda a: ordering.postorder(ordering.elimination_tree(a))), _cases("k", "k", "k"))
add("inverse_postorder", _analysed(lambda a: ordering.inverse_permutation(ordering.postorder(ordering.elimination_tree(a))[::-1])), _cases(*[f"{_last} - k"] * 3))
add("symbolic_cholesky", _analysed(lambda a: [i for column in ordering.symbolic_cholesky(a) for i in column]), "SELECT name, row_number() OVER (PARTITION BY name ORDER BY j, i) - 1 AS k, i AS v FROM (SELECT n.name, j, i FROM (VALUES ('chain'), ('star'), ('full')) n(name), " + f"range({_SIZE}) a(j), range({_SIZE}) b(i) WHERE i = j OR i > j AND (name = 'full' OR name = 'chain' AND i = j + 1 OR name = 'star' AND i = {_last}))")
add("find_supernodes", _analysed(lambda a: ordering.find_supernodes(ordering.elimination_tree(a), ordering.column_counts(a))), f"SELECT 'chain' AS name, k, k AS v FROM range({_last}) t(k) UNION ALL SELECT 'star', k, k FROM range({_SIZE}) t(k) UNION ALL SELECT 'full', 0, 0")
add("column_supernodes", _analysed(lambda a: ordering.column_supernodes(ordering.elimination_tree(a), ordering.column_counts(a))[0]), _cases(f"least(k, {_last - 1})", "k", "0"))


def _two_steps(a: Csr) -> Csr:
    """The lower part: its ``A^T A`` links what a column has in common with others."""
    keep = a.rows >= a.idx
    return Csr(*a.shape, a.rows[keep], a.idx[keep], a.val[keep])


add("column_elimination_tree", _analysed(lambda a: ordering.column_elimination_tree(_two_steps(a))), _cases(_up, _up, _up))
add("column_counts_ata", _analysed(lambda a: ordering.column_counts_ata(_two_steps(a))), _cases(_two, f"{_SIZE} - k", f"{_SIZE} - k"))
add("analyze_unsymmetric", _analysed(lambda a: ordering.analyze_unsymmetric(_two_steps(a), ordering.natural(a))["counts"]), _cases(_two, f"{_SIZE} - k", f"{_SIZE} - k"))
add("etree_leaf", _analysed(lambda a: [lca for i, j, kind, lca in ordering.row_leaves(a, ordering.elimination_tree(a)) if i == _last]), f"SELECT 'chain' AS name, CAST(0 AS BIGINT) AS k, CAST({_last} AS BIGINT) AS v UNION ALL SELECT 'star', k, CAST({_last} AS BIGINT) FROM range({_last}) t(k) UNION ALL SELECT 'full', 0, {_last}")
add("ldlt_symbolic", _analysed(lambda a: np.diff(supernodal.ldlt_symbolic(a, None).starts)), f"SELECT 'chain' AS name, k, CAST(CASE WHEN k = {_last - 1} THEN 2 ELSE 1 END AS BIGINT) AS v FROM range({_last}) t(k) UNION ALL SELECT 'star', k, 1 FROM range({_SIZE}) t(k) UNION ALL SELECT 'full', 0, {_SIZE}")


def _orderings(s: SparkSession, sf: str) -> DataFrame:
    """Each ordering's numbers, sorted; the fill it leaves is at most the natural one's."""
    a = to_csr(gen.laplacian_2d(s, 12, 12))
    own = ordering.total_nnz(ordering.column_counts(a))
    rows = []
    for f in (ordering.natural, ordering.rcm, ordering.amd, ordering.colamd):
        p = f(a)
        less = ordering.total_nnz(ordering.column_counts(a.permuted(p, p))) <= own
        rows += [(f.__name__, k, int(v), bool(less)) for k, v in enumerate(np.sort(p))]
    return s.createDataFrame(rows, "name string, k long, v long, less boolean")


add("orderings", _orderings, "SELECT name, k, k AS v, true AS less FROM (VALUES ('natural'), ('rcm'), ('amd'), ('colamd')) n(name), range(144) t(k)")


def _rows64(s: SparkSession, sf: str) -> DataFrame:
    return fx.table(s, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("row"))


def _tall_qr(s: SparkSession, sf: str) -> DataFrame:
    """``R^T R`` of all embeddings: their Gram matrix."""
    r = grouped.tall_r(_rows64(s, sf), 64)
    g = np.round(r.T @ r * 1e3).astype(np.int64)
    i, j = np.indices(g.shape)
    return s.createDataFrame(pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": g.ravel()}))


add("tall_qr", _tall_qr, "SELECT i, j, CAST(round(1000 * sum(CAST(embedding[i + 1] AS DOUBLE) * CAST(embedding[j + 1] AS DOUBLE))) AS BIGINT) AS v FROM embeddings, range(64) t(i), range(64) s(j) GROUP BY 1, 2")


# Larger ones, for timing

_LARGE = 1025


def _large(s: SparkSession, sf: str, column: str) -> Matrix:
    """All quantities folded to 1025 x 1025."""
    rows = fx.table(s, sf, "lineitem").select((F.col("l_orderkey") % _LARGE).alias("i"), (F.col(column) % _LARGE).alias("j"), F.col("l_quantity").cast("bigint").alias("v"))
    return Matrix(rows.groupBy("i", "j").agg(F.sum("v").alias("v")), _LARGE, _LARGE)


_folded = lambda column: f"(SELECT l_orderkey % {_LARGE} AS i, {column} % {_LARGE} AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"
add(
    "gemm_1025",
    lambda s, sf: products.matmul_blocks(_large(s, sf, "l_partkey"), _large(s, sf, "l_suppkey"), 256).df.where("v <> 0").select("i", "j", F.col("v").cast("bigint").alias("v")),
    f"SELECT a.i, b.j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {_folded('l_partkey')} a JOIN {_folded('l_suppkey')} b ON a.j = b.i GROUP BY 1, 2",
)


def _dense_1025(solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Query:
    """One system with a strong diagonal, in one task, for the solution ``i % 97 + 1``."""

    def kernel(a: np.ndarray) -> np.ndarray:
        a = a + a.T + 1e6 * np.eye(_LARGE)
        return np.round(1000 * solve(a, a @ (np.arange(_LARGE) % 97 + 1.0)))[:, None]

    def run(s: SparkSession, sf: str) -> DataFrame:
        a = _large(s, sf, "l_partkey").df.withColumn("id", F.lit(0).cast("long"))
        return grouped.map_elements(a, _LARGE, _LARGE, kernel).select("i", F.col("v").cast("bigint").alias("v"))

    return run


for _name, _f in {
    "lu_1025": dense.lu_apply,
    "cholesky_1025": lambda a, b: dense.cholesky_solve(dense.cholesky_factor(a)[0], b),
    "qr_1025": dense.qr_solve,
}.items():
    add(_name, _dense_1025(_f), f"SELECT i, 1000 * (i % 97 + 1) AS v FROM range({_LARGE}) t(i)")


def _cg_10000(s: SparkSession, sf: str) -> DataFrame:
    a = gen.laplacian_2d(s, 100, 100)
    b = products.mult(a, _truth(s, sf, 10_000)).to_numpy()
    x, code = krylov.cg(a, b, it=Iteration(float(np.linalg.norm(b)), 5000, 1e-12))
    return _numbers(s, x, code=code)


add("cg_10000", _cg_10000, _known(10_000, _code))
