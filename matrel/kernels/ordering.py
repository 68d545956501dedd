"""Orderings and graph algorithms of sparse patterns. A permutation p lists old indices in new order."""

from __future__ import annotations

import heapq
import math

import numpy as np

from matrel.solvers.operators import Csr


def aplusat_pattern(a: Csr) -> list[set[int]]:
    """Neighbours in the pattern of ``A + A^T`` without the diagonal."""
    out: list[set[int]] = [set() for _ in range(max(a.shape))]
    for i, j in zip(a.rows.tolist(), a.idx.tolist(), strict=True):
        if i != j:
            out[i].add(j)
            out[j].add(i)
    return out


def dense_threshold(n: int) -> int:
    """Entries from which a row counts as dense."""
    return max(16, int(10 * math.sqrt(n)))


def ata_pattern(a: Csr, drop_dense: bool = True) -> list[set[int]]:
    """Columns that meet in a row, without the diagonal; dense rows are left out."""
    out: list[set[int]] = [set() for _ in range(a.shape[1])]
    most = dense_threshold(a.shape[1]) if drop_dense else a.shape[1] + 1
    for i in range(a.shape[0]):
        idx = a.row(i)[0].tolist()
        if len(idx) <= most:
            for j in idx:
                out[j].update(idx)
    for j, s in enumerate(out):
        s.discard(j)
    return out


def minimum_degree(neighbours: list[set[int]]) -> np.ndarray:
    """By least degree in a quotient graph: eliminated nodes become elements that stand for their clique, and elements are absorbed."""
    n = len(neighbours)
    nodes = [set(s) for s in neighbours]
    elements: list[set[int]] = [set() for _ in range(n)]
    members: dict[int, set[int]] = {}
    alive = [True] * n
    heap = [(len(s), i) for i, s in enumerate(nodes)]
    heapq.heapify(heap)
    degree = [len(s) for s in nodes]
    order = []
    while heap:
        d, p = heapq.heappop(heap)
        if not alive[p] or d != degree[p]:
            continue
        alive[p] = False
        order.append(p)
        clique = {x for x in nodes[p] if alive[x]}
        for e in elements[p]:
            clique |= {x for x in members.pop(e) if alive[x]}
        clique.discard(p)
        absorbed = elements[p]
        members[p] = clique
        for x in clique:
            nodes[x] -= clique
            nodes[x].discard(p)
            elements[x] -= absorbed
            elements[x].add(p)
        for x in clique:
            reach = set(nodes[x])
            for e in elements[x]:
                reach |= members[e]
            reach.discard(x)
            degree[x] = len(reach)
            heapq.heappush(heap, (degree[x], x))
    return np.array(order, int)


def amd(a: Csr) -> np.ndarray:
    return minimum_degree(aplusat_pattern(a))


def colamd(a: Csr) -> np.ndarray:
    return minimum_degree(ata_pattern(a))


def natural(a: Csr) -> np.ndarray:
    return np.arange(a.shape[1])


def rcm(a: Csr) -> np.ndarray:
    """Breadth first from a node of least degree in each component, neighbours by degree, reversed."""
    near = aplusat_pattern(a)
    degree = np.diff(a.ptr)
    seen, order = [False] * len(near), []
    for start in np.argsort(degree, kind="stable").tolist():
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        for x in queue:
            fresh = sorted((y for y in near[x] if not seen[y]), key=lambda y: (degree[y], y))
            for y in fresh:
                seen[y] = True
            queue += fresh
        order += queue
    return np.array(order[::-1], int)


def bandwidth(a: Csr) -> int:
    return int(np.abs(a.rows - a.idx).max(initial=0))


def maximum_matching(a: Csr) -> np.ndarray:
    """For each column its matched row, or -1, by augmenting paths."""
    n = a.shape[1]
    t = a.transpose()
    row_of, col_of = np.full(n, -1), np.full(a.shape[0], -1)
    for start in range(n):
        seen: set[int] = set()
        stack = [(start, iter(t.row(start)[0].tolist()))]
        path: list[int] = []
        while stack:
            col, rows = stack[-1]
            for r in rows:
                if r in seen:
                    continue
                seen.add(r)
                path.append(r)
                if col_of[r] < 0:
                    for (c, _), q in zip(stack, path, strict=True):
                        row_of[c], col_of[q] = q, c
                    stack = []
                else:
                    stack.append((int(col_of[r]), iter(t.row(int(col_of[r]))[0].tolist())))
                break
            else:
                stack.pop()
                if path:
                    path.pop()
    return row_of


def tarjan_scc(near: list[list[int]]) -> np.ndarray:
    """Component numbers in reverse topological order, without recursion."""
    n = len(near)
    index, low, comp = [-1] * n, [0] * n, np.full(n, -1)
    held: list[int] = []
    count = found = 0
    for root in range(n):
        if index[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, k = work.pop()
            if k == 0:
                index[v] = low[v] = count
                count += 1
                held.append(v)
            elif k > 0:
                low[v] = min(low[v], low[near[v][k - 1]]) if comp[near[v][k - 1]] < 0 else low[v]
            for m in range(k, len(near[v])):
                w = near[v][m]
                if index[w] < 0:
                    work += [(v, m + 1), (w, 0)]
                    break
                if comp[w] < 0:
                    low[v] = min(low[v], index[w])
            else:
                if low[v] == index[v]:
                    while True:
                        w = held.pop()
                        comp[w] = found
                        if w == v:
                            break
                    found += 1
    return comp


def block_triangular_form(a: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(row order, column order, block starts, structurally singular): the permuted matrix is block upper triangular with a full diagonal."""
    n = a.shape[0]
    match = maximum_matching(a)
    if (match < 0).any() or a.shape[0] != a.shape[1]:
        return np.arange(n), np.arange(a.shape[1]), np.array([0, n]), True
    col_of = np.empty(n, int)
    col_of[match] = np.arange(n)
    # edge from the column matched to a row to each column in the row
    near = [a.row(int(match[c]))[0].tolist() for c in range(n)]
    comp = tarjan_scc(near)
    # reverse topological numbers: blocks that are reached come first, so the order is turned
    cols = np.lexsort((np.arange(n), -comp))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(comp[cols]) != 0]))
    return match[cols], cols, np.append(starts, n), False


def elimination_tree(a: Csr) -> np.ndarray:
    """Each column's parent, -1 for a root, with path compression. Reads the pattern's lower triangle."""
    n = a.shape[0]
    parent, above = np.full(n, -1), np.full(n, -1)
    for i in range(n):
        for j in a.row(i)[0].tolist():
            while j != -1 and j < i:
                up = above[j]
                above[j] = i
                if up == -1:
                    parent[j] = i
                j = up
    return parent


def column_elimination_tree(a: Csr) -> np.ndarray:
    """That of ``A^T A``, which isn't formed."""
    n = a.shape[1]
    parent, above = np.full(n, -1), np.full(n, -1)
    last = np.full(a.shape[0], -1)
    t = a.transpose()
    for k in range(n):
        for r in t.row(k)[0].tolist():
            i = last[r]
            while i != -1 and i < k:
                up = above[i]
                above[i] = k
                if up == -1:
                    parent[i] = k
                i = up
            last[r] = k
    return parent


def postorder(parent: np.ndarray) -> np.ndarray:
    """Children before parents, depth first, children ascending."""
    n = len(parent)
    kids: list[list[int]] = [[] for _ in range(n)]
    for v in range(n - 1, -1, -1):
        if parent[v] >= 0:
            kids[parent[v]].append(v)
    order = []
    for root in (v for v in range(n) if parent[v] < 0):
        stack = [root]
        while stack:
            v = stack[-1]
            if kids[v]:
                stack.append(kids[v].pop())
            else:
                order.append(stack.pop())
    return np.array(order, int)


def inverse_permutation(p: np.ndarray) -> np.ndarray:
    out = np.empty(len(p), int)
    out[p] = np.arange(len(p))
    return out


def row_pattern(a: Csr, parent: np.ndarray, i: int) -> list[int]:
    """The columns of row i of the Cholesky factor, without the diagonal, ascending: paths in the tree up to i."""
    mark, out = {i}, []
    for j in a.row(i)[0].tolist():
        while j < i and j not in mark:
            mark.add(j)
            out.append(j)
            j = int(parent[j])
            if j < 0:
                break
    return sorted(out)


def symbolic_cholesky(a: Csr, parent: np.ndarray | None = None) -> list[list[int]]:
    """The pattern of each column of L, with the diagonal, ascending."""
    parent = elimination_tree(a) if parent is None else parent
    cols: list[list[int]] = [[k] for k in range(a.shape[0])]
    for i in range(a.shape[0]):
        for j in row_pattern(a, parent, i):
            cols[j].append(i)
    return cols


def column_counts(a: Csr, parent: np.ndarray | None = None) -> np.ndarray:
    return np.array([len(c) for c in symbolic_cholesky(a, parent)], int)


def column_counts_ata(a: Csr) -> np.ndarray:
    """Counts of the Cholesky factor of ``A^T A``."""
    near = ata_pattern(a, drop_dense=False)
    rows = np.array([i for i, s in enumerate(near) for _ in range(len(s) + 1)], int)
    cols = np.array([j for i, s in enumerate(near) for j in [*s, i]], int)
    return column_counts(Csr(len(near), len(near), rows, cols, np.ones(len(rows))))


def total_nnz(counts: np.ndarray) -> int:
    return int(counts.sum())


def find_supernodes(parent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Starts of fundamental supernodes: runs of columns, each the only child of the next, with nested patterns."""
    n = len(parent)
    kids = np.bincount(parent[parent >= 0], minlength=n)
    starts = [k for k in range(n) if k == 0 or parent[k - 1] != k or counts[k - 1] != counts[k] + 1 or kids[k] != 1]
    return np.array(starts, int)


def column_supernodes(parent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(supernode of each column, starts with the end) of a column tree in postorder."""
    starts = find_supernodes(parent, counts)
    ends = np.append(starts, len(parent))
    return np.repeat(np.arange(len(starts)), np.diff(ends)), ends


def first_descendants(parent: np.ndarray) -> np.ndarray:
    """The least column in each column's subtree; the tree is in postorder."""
    first = np.arange(len(parent))
    for k, up in enumerate(parent.tolist()):
        if up >= 0:
            first[up] = min(first[up], first[k])
    return first


def etree_leaf(parent: np.ndarray, first: np.ndarray, i: int, j: int, before: int) -> tuple[int, int]:
    """(kind, ancestor) of column j in the subtree of row i, the leaf before it being ``before`` (-1: none).

    Kind 0: no leaf, as one came that lies below it; 1: the first leaf, whose ancestor is the row itself; 2: a later one,
    with the least common ancestor of it and the one before.
    """
    if i <= j or before >= first[j]:
        return 0, -1
    if before < 0:
        return 1, i
    up = before
    while up < j:
        up = int(parent[up])
    return 2, up


def row_leaves(a: Csr, parent: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, column, kind, ancestor) of all leaves of the rows' subtrees, columns ascending."""
    first = first_descendants(parent)
    out = []
    for i in range(a.shape[0]):
        before = -1
        for j in a.row(i)[0].tolist():
            kind, up = etree_leaf(parent, first, i, j, before)
            if kind:
                out.append((i, j, kind, up))
                before = j
    return out


def analyze_unsymmetric(a: Csr, order: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Column order, tree, postorder, counts and supernodes of an unsymmetric matrix."""
    q = colamd(a) if order is None else order
    b = a.permuted(None, q)
    parent = column_elimination_tree(b)
    post = postorder(parent)
    b = b.permuted(None, post)
    q = q[post]
    parent = column_elimination_tree(b)
    counts = column_counts_ata(b)
    return {"order": q, "parent": parent, "post": post, "counts": counts, "supernodes": find_supernodes(parent, counts)}
