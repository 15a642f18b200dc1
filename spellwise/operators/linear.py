"""Small dense algebra for the driver: rank, solving and inverting symmetric matrices by one scaled, pivoted factor.

Sums are written as element-wise operations, so nothing here starts the threads of a linear algebra library next to the JVM.
Matrices are p x p for p model columns; rows of data never come here.
"""

from __future__ import annotations

import numpy as np

#: Share of a column's own scale below which what is left of it counts as rounding.
TOLERANCE = 1e-9


def independent(a: np.ndarray, scale: np.ndarray | None = None, tol: float = TOLERANCE) -> np.ndarray:
    """Columns kept when redundant ones are left out from left to right.

    ``scale`` is the size of the terms each diagonal entry was computed from. An entry that is a difference of large
    sums is known only to their rounding, so a column is redundant if less than ``tol`` of its scale is left.
    """
    rest = np.array(a, dtype=float)
    scale = np.maximum(np.diag(rest) if scale is None else np.asarray(scale, dtype=float), 0.0)
    kept = []
    for j in range(len(rest)):
        if scale[j] <= 0 or not rest[j, j] > tol * scale[j]:
            continue
        kept.append(j)
        rest -= rest[:, j, None] * (rest[j] / rest[j, j])[None, :]
    return np.array(kept, dtype=int)


class Factor:
    """``a = S P L L' P' S``: Cholesky of the matrix scaled to a unit diagonal, greatest remaining pivot first.

    Pivots at or below ``tol`` end it; ``rank`` and ``order`` tell what was used, and the rest gets zeros.
    """

    def __init__(self, a: np.ndarray, tol: float = 1e-13):
        a = np.asarray(a, dtype=float)
        n = len(a)
        self.n = n
        self.scale = np.sqrt(np.maximum(np.diag(a), 0.0))
        safe = np.where(self.scale > 0, self.scale, 1.0)
        rest = a / safe[:, None] / safe[None, :]
        self.order = np.arange(n)
        self.lower = np.zeros((n, n))
        self.rank = n
        for k in range(n):
            at = k + int(np.argmax(np.diag(rest)[self.order[k:]])) if k < n else k
            self.order[[k, at]] = self.order[[at, k]]
            self.lower[[k, at], :k] = self.lower[[at, k], :k]
            j = self.order[k]
            pivot = rest[j, j]
            if not pivot > tol:
                self.rank = k
                break
            column = rest[self.order[k:], j] / np.sqrt(pivot)
            self.lower[k:, k] = column
            idx = self.order[k:]
            rest[np.ix_(idx, idx)] -= column[:, None] * column[None, :]
        self.used = self.order[: self.rank]

    def solve(self, b: np.ndarray) -> np.ndarray:
        """Solution of ``a x = b`` on the pivots used, zero elsewhere; ``b`` may have several columns."""
        b = np.asarray(b, dtype=float)
        wide = b.reshape(self.n, -1)
        lower, r = self.lower[: self.rank, : self.rank], self.rank
        y = wide[self.used] / self.scale[self.used, None] if r else np.zeros((0, wide.shape[1]))
        for i in range(r):
            y[i] = (y[i] - (lower[i, :i, None] * y[:i]).sum(axis=0)) / lower[i, i]
        for i in reversed(range(r)):
            y[i] = (y[i] - (lower[i + 1 :, i, None] * y[i + 1 :]).sum(axis=0)) / lower[i, i]
        out = np.zeros_like(wide)
        if r:
            out[self.used] = y / self.scale[self.used, None]
        return out.reshape(b.shape)

    def inverse(self) -> np.ndarray:
        inv = self.solve(np.eye(self.n))
        return (inv + inv.T) / 2

    def quadratic(self, s: np.ndarray) -> float:
        """``s' a^- s``."""
        return float((np.asarray(s, dtype=float) * self.solve(s)).sum())


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a b`` of small matrices."""
    return np.einsum("ij,jk->ik", a, b)


def root(v: np.ndarray) -> np.ndarray:
    """A matrix ``r`` with ``v = r r'`` (rows as in ``v``) for a symmetric ``v`` without negative directions."""
    f = Factor(v, tol=1e-15)
    out = np.zeros((f.n, f.rank))
    for k in range(f.n):
        out[f.order[k]] = f.lower[k, : f.rank] * f.scale[f.order[k]]
    return out
