"""Lowest eigenvalues on one mesh component (bounded by the mesh budget)."""

from __future__ import annotations

import numpy as np

SETTLED, LEAST_ROUNDS = 1e-7, 40  # of the eigenvalue search
FIRST_SHIFT, SHIFTS = 1e-6, 8  # of the largest ratio of diagonals; each next one is ten times as large
FACTOR_NUMBERS = 1 << 25  # in half a factor: 256 MiB


class Rows:
    """Sparse symmetric matrices of one component, sorted by row."""

    def __init__(self, i, j, *values):
        self.names, flat = np.unique(np.concatenate([i, j]), return_inverse=True)
        i, self.col = flat[:len(i)], flat[len(i):]
        order = np.argsort(i, kind="stable")
        self.col = self.col[order]
        row = i[order]
        self.start = np.searchsorted(row, np.arange(len(self.names)))
        self.on_diagonal = row == self.col
        self.values = [v[order] for v in values]

    def times(self, values, x):
        """Product with a vector, or with the columns of a matrix."""
        return np.add.reduceat((values if x.ndim == 1 else values[:, None]) * x[self.col], self.start, axis=0)

    def position(self, names):
        return np.searchsorted(self.names, names)

    def diagonal(self, values):
        return values[self.on_diagonal]

    def band(self):
        return int(np.max(np.abs(np.repeat(np.arange(len(self.names)), np.diff(self.start, append=len(self.col))) - self.col), initial=0))

    def factored(self, values):
        """Solver of a positive definite matrix by Cholesky blocks of its band's width; None if it is not.

        On a lattice in row-major order the band is one lattice row wide.
        """
        n, w = len(self.names), max(self.band(), 32)
        count = -(-n // w)
        row = np.repeat(np.arange(n), np.diff(self.start, append=len(self.col)))
        own, below = np.zeros((count, w, w)), np.zeros((count, w, w))
        for held, gap in ((own, 0), (below, 1)):
            here = row // w - self.col // w == gap
            np.add.at(held, (row[here] // w, row[here] % w, self.col[here] % w), values[here])
        left = np.arange(n, count * w)
        own[left // w, left % w, left % w] = 1.0
        try:
            for b in range(count):
                if b:
                    below[b] = below[b] @ own[b - 1].T
                    own[b] -= below[b] @ below[b].T
                own[b] = np.linalg.inv(np.linalg.cholesky(own[b]))
        except np.linalg.LinAlgError:
            return None

        def solve(x):
            y = np.zeros((count * w, x.shape[1]))
            y[:n] = x
            y = y.reshape(count, w, -1)
            for b in range(count):
                y[b] = own[b] @ (y[b] - below[b] @ y[b - 1] if b else y[b])
            for b in reversed(range(count)):
                y[b] = own[b].T @ (y[b] - below[b + 1].T @ y[b + 1] if b + 1 < count else y[b])
            return y.reshape(count * w, -1)[:n]

        return solve


def _ritz(rows: Rows, stiffness, mass, basis, wanted):
    """Best approximations to the lowest eigenpairs inside the span of ``basis``."""
    basis = basis / np.maximum(np.linalg.norm(basis, axis=0), 1e-300)
    gram = basis.T @ rows.times(mass, basis)
    size, ways = np.linalg.eigh((gram + gram.T) / 2)
    kept = size > 1e-12 * size.max()
    basis = basis @ (ways[:, kept] / np.sqrt(size[kept]))
    small = basis.T @ rows.times(stiffness, basis)
    value, y = np.linalg.eigh((small + small.T) / 2)
    x = basis @ y[:, :wanted]
    value = value[: x.shape[1]]
    return value, x, rows.times(stiffness, x) - rows.times(mass, x) * value


def _steered(rows: Rows, stiffness, mass, scale):
    """(solver of K + s M, whether the first s did), or None."""
    if len(rows.names) * max(rows.band(), 32) > FACTOR_NUMBERS or not (np.isfinite(stiffness).all() and np.isfinite(mass).all()):
        return None
    for k in range(SHIFTS):
        solve = rows.factored(stiffness + FIRST_SHIFT * 10.0 ** k * scale * mass)
        if solve is not None:
            return solve, k == 0
    return None


def smallest_eigenvalues(rows: Rows, stiffness, mass, count=1, limit=3000):
    """The ``count`` smallest eigenvalues of K v = lambda M v, negative ones included.

    A block of vectors descends on the Rayleigh quotient along preconditioned
    residuals and its last steps.  Minima of the quotient are eigenvalues of the
    lowest end only, so an indefinite K is found out whatever the start; one
    vector more than asked for has to settle too.  Raises if they do not settle.
    Residuals go through a factor of K + s M, with the first s that makes it
    positive definite, so rounds are few whatever the size; matrices whose factor
    is too large take the inverse diagonal and more rounds.
    """
    n = len(rows.names)
    block = min(n, count + 3)
    x = np.random.default_rng(0).standard_normal((n, block))
    x[:, 0] = 1.0  # constants carry no stiffness
    diagonal, weight = np.abs(rows.diagonal(stiffness)), np.abs(rows.diagonal(mass))
    scale = max(float(np.max(diagonal / np.maximum(weight, 1e-300))), 1e-300)
    inverse = 1.0 / (diagonal + 1e-3 * scale * weight + 1e-300)
    steer, definite = _steered(rows, stiffness, mass, scale) or (lambda x: inverse[:, None] * x, False)
    least = 3 if definite else LEAST_ROUNDS  # a definite factor shows that nothing lies below -s
    value, x, residual = _ritz(rows, stiffness, mass, np.eye(n) if n <= 3 * block else x, block)
    step = np.zeros((n, 0))
    watched = min(count + 1, block)
    for round_ in range(limit):
        off = np.linalg.norm(residual, axis=0) / (scale * np.maximum(np.linalg.norm(rows.times(mass, x), axis=0), 1e-300))
        if (round_ >= least or n <= 3 * block) and off[:count].max() <= SETTLED and off[:watched].max() <= 1e3 * SETTLED:
            return value[:count]
        old = x
        value, x, residual = _ritz(rows, stiffness, mass, np.column_stack([x, steer(residual), step]), block)
        step = x - old @ (old.T @ rows.times(mass, x))
    raise RuntimeError("the smallest eigenvalues did not settle")


def smallest_eigenvalue(rows: Rows, stiffness, mass):
    return float(smallest_eigenvalues(rows, stiffness, mass)[0])
