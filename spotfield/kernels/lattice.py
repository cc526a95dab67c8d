"""Nine-point operators on one tile of a node lattice: products, smoothing, coarsening, elimination.

An operator is an array (9, rows, columns) with the coefficient of the neighbour
``OFFSETS[k]`` of each node; fields are arrays (fields, rows, columns).  Tiles carry
a rim of ``HALO`` nodes, which is as far as one half of a multigrid cycle looks.
Coefficients are zero where there is no node.
"""

from __future__ import annotations

import numpy as np

OFFSETS = [(dj, di) for dj in (-1, 0, 1) for di in (-1, 0, 1)]
HALO = 4
SMALLEST = 8  # nodes across the coarsest lattice, which is solved directly
# steps of two sweeps that damp the upper three quarters of a spectrum within (0, 2]
RATES = tuple(1.0 / (1.25 + 0.75 * np.cos(np.pi * (2 * k + 1) / 4)) for k in range(2))


def product(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Right everywhere but on the outermost ring."""
    y = np.zeros_like(x)
    rows, cols = x.shape[1:]
    inner = y[:, 1:-1, 1:-1]
    for k, (dj, di) in enumerate(OFFSETS):
        inner += a[k, 1:-1, 1:-1] * x[:, 1 + dj:rows - 1 + dj, 1 + di:cols - 1 + di]
    return y


def damping(a: np.ndarray) -> np.ndarray:
    """Inverse diagonal, enlarged where needed to keep the spectrum of the scaled operator within two."""
    d = np.maximum(a[4], 0.5 * np.abs(a).sum(axis=0))
    return np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)


def smoothed(a, w, r):
    """Two sweeps from zero."""
    x = RATES[0] * w * r
    return x + RATES[1] * w * (r - product(a, x))


def resmoothed(a, w, r, x):
    """The same two sweeps in turned order, so that a cycle is symmetric."""
    x = x + RATES[1] * w * (r - product(a, x))
    return x + RATES[0] * w * (r - product(a, x))


def _bilinear(e: np.ndarray) -> np.ndarray:
    n, rows, cols = e.shape
    tall = np.zeros((n, 2 * rows, cols))
    tall[:, ::2] = e
    tall[:, 1:-1:2] = 0.5 * (e[:, :-1] + e[:, 1:])
    tall[:, -1] = 0.5 * e[:, -1]
    out = np.zeros((n, 2 * rows, 2 * cols))
    out[:, :, ::2] = tall
    out[:, :, 1:-1:2] = 0.5 * (tall[:, :, :-1] + tall[:, :, 1:])
    out[:, :, -1] = 0.5 * tall[:, :, -1]
    return out


def _gathered(t: np.ndarray) -> np.ndarray:
    """Transpose of :func:`_bilinear`."""
    c = t[:, :, ::2] + 0.5 * t[:, :, 1::2]
    c[:, :, 1:] += 0.5 * t[:, :, 1:-1:2]
    out = c[:, ::2] + 0.5 * c[:, 1::2]
    out[:, 1:] += 0.5 * c[:, 1:-1:2]
    return out


class Transfer:
    """Interpolation from every second node; weights of missing nodes go to the others, so constants stay."""

    def __init__(self, mask: np.ndarray):
        self.coarse = mask[::2, ::2].astype(float)
        total = _bilinear(self.coarse[None])[0]
        self.scale = np.divide(1.0, total, out=np.zeros_like(total), where=mask & (total > 0))

    def up(self, e):
        return _bilinear(e * self.coarse) * self.scale

    def down(self, r):
        return _gathered(r * self.scale) * self.coarse


def coarsened(a: np.ndarray, transfer: Transfer) -> np.ndarray:
    """The operator between coarse nodes, column by column: nodes three apart do not see each other."""
    rows, cols = transfer.coarse.shape
    out = np.zeros((9, rows, cols))
    for cj in range(3):
        for ci in range(3):
            e = np.zeros((1, rows, cols))
            e[0, cj::3, ci::3] = 1.0
            y = transfer.down(product(a, transfer.up(e)))[0]
            for k, (dj, di) in enumerate(OFFSETS):
                out[k, (cj - dj) % 3::3, (ci - di) % 3::3] = y[(cj - dj) % 3::3, (ci - di) % 3::3]
    # a neighbour that is no node has no column
    padded = np.pad(transfer.coarse, 1)
    for k, (dj, di) in enumerate(OFFSETS):
        out[k] *= padded[1 + dj:1 + dj + rows, 1 + di:1 + di + cols]
    return out


def framed(core: np.ndarray) -> np.ndarray:
    """A core with even sides inside an empty rim."""
    _, rows, cols = core.shape
    return np.pad(core, ((0, 0), (HALO, HALO + rows % 2), (HALO, HALO + cols % 2)))


def hierarchy(k: np.ndarray, m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ever coarser stiffness and mass of a lattice that one tile holds, each within a rim."""
    levels = [(k, m)]
    while max(k.shape[1:]) - 2 * HALO > SMALLEST:
        transfer = Transfer(m[4] > 0)
        k, m = (framed(coarsened(a, transfer)[:, 2:-2, 2:-2]) for a in (k, m))
        levels.append((k, m))
    return levels


def inverted(a: np.ndarray, mask: np.ndarray) -> tuple:
    """Places of the nodes of a small lattice and the inverse of its operator."""
    name = np.full(mask.shape, -1)
    j, i = np.nonzero(mask)
    name[j, i] = np.arange(len(j))
    dense = np.zeros((len(j), len(j)))
    for k, (dj, di) in enumerate(OFFSETS):
        other = name[j + dj, i + di]
        dense[np.flatnonzero(other >= 0), other[other >= 0]] = a[k, j, i][other >= 0]
    return j, i, np.linalg.inv(dense) if len(j) else dense


class Cycle:
    """One symmetric cycle for ``kappa K + sigma M``, down the levels and up again; what all rounds share is made once."""

    def __init__(self, levels, kappa: float, sigma: float, transfers: list | None = None):
        self.transfers = transfers_of(levels) if transfers is None else transfers
        self.operators = [kappa * k + sigma * m for k, m in levels]
        self.weights = [damping(a) for a in self.operators[:-1]]
        self.bottom = inverted(self.operators[-1], levels[-1][1][4] > 0)

    def __call__(self, r: np.ndarray, at: int = 0) -> np.ndarray:
        a = self.operators[at]
        if at == len(self.operators) - 1:
            j, i, inverse = self.bottom
            x = np.zeros_like(r)
            x[:, j, i] = r[:, j, i] @ inverse.T
            return x
        w, transfer = self.weights[at], self.transfers[at]
        x = smoothed(a, w, r)
        below = framed(transfer.down(r - product(a, x))[:, 2:-2, 2:-2])
        e = self(below, at + 1)
        rows, cols = transfer.coarse.shape
        return resmoothed(a, w, r, x + transfer.up(e[:, 2:2 + rows, 2:2 + cols]))


def transfers_of(levels) -> list[Transfer]:
    return [Transfer(m[4] > 0) for _, m in levels[:-1]]


def cycle(levels, r: np.ndarray, kappa: float, sigma: float) -> np.ndarray:
    return Cycle(levels, kappa, sigma)(r)


def conjugate_gradients(levels, b: np.ndarray, kappa: float, sigma: float, tolerance: float, limit: int, transfers: list | None = None) -> np.ndarray:
    """Solves ``kappa K + sigma M`` on a lattice that one tile holds; a field that is done rests."""
    once = Cycle(levels, kappa, sigma, transfers)
    a = once.operators[0]
    bound = tolerance ** 2 * (b * b).sum(axis=(1, 2))
    x, r, on = np.zeros_like(b), b.copy(), np.arange(len(b))
    p, rz = np.zeros_like(b), np.ones(len(b))
    for _ in range(limit):
        on = on[(r[on] * r[on]).sum(axis=(1, 2)) > bound[on]]
        if not len(on):
            return x
        z = once(r[on])
        new = (r[on] * z).sum(axis=(1, 2))
        p[on] = z + (new / rz[on])[:, None, None] * p[on]
        rz[on] = new
        ap = product(a, p[on])
        step = (new / (p[on] * ap).sum(axis=(1, 2)))[:, None, None]
        x[on] += step * p[on]
        r[on] -= step * ap
    raise RuntimeError(f"a transport system did not settle in {limit} rounds")


# -- elimination ------------------------------------------------------------------

LINE = 128  # nodes of a lattice line; lattices wider both ways are left to rounds
NUMBERS = 1 << 23  # of the inverses held at once: 64 MiB


def _across(c, z):
    """What each line receives through ``c`` (3, shifts, nodes), the coefficients of the line before."""
    out = c[1][..., None] * z
    out[:, 1:] += c[0][:, 1:, None] * z[:, :-1]
    out[:, :-1] += c[2][:, :-1, None] * z[:, 1:]
    return out


def _back(c, x):
    """Transpose of :func:`_across`."""
    out = c[1][..., None] * x
    out[:, :-1] += c[0][:, 1:, None] * x[:, 1:]
    out[:, 1:] += c[2][:, :-1, None] * x[:, :-1]
    return out


def _turned(a):
    return np.ascontiguousarray(a.reshape(3, 3, *a.shape[1:]).transpose(1, 0, 3, 2)).reshape(9, a.shape[2], a.shape[1])


def _eliminated(a, load):
    """Solutions (rows, shifts, nodes of a line, loads) of symmetric operators ``a`` (9, rows, shifts, nodes), line after line."""
    _, rows, n, cols = a.shape
    at = np.arange(cols)
    inverse = np.empty((rows, n, cols, cols))
    y = np.empty((rows, n, cols, load.shape[-1]))
    for j in range(rows):
        own = np.zeros((n, cols, cols))
        own[:, at, at] = np.where(a[4, j] == 0, 1.0, a[4, j])
        own[:, at[1:], at[:-1]], own[:, at[:-1], at[1:]] = a[3, j][:, 1:], a[5, j][:, :-1]
        y[j] = load[j]
        if j:
            across = np.zeros((n, cols, cols))
            across[:, at, at], across[:, at[1:], at[:-1]], across[:, at[:-1], at[1:]] = a[1, j], a[0, j][:, 1:], a[2, j][:, :-1]
            own -= across @ inverse[j - 1] @ across.transpose(0, 2, 1)
            y[j] -= _across(a[:3, j], y[j - 1])
        inverse[j] = np.linalg.inv(own)
        y[j] = inverse[j] @ y[j]
    for j in reversed(range(rows - 1)):
        y[j] -= inverse[j] @ _back(a[:3, j + 1], y[j + 1])
    return y


def direct(k: np.ndarray, m: np.ndarray, b: np.ndarray, shifts: list[tuple[float, float]], tolerance: float):
    """Solutions of ``kappa K + sigma M`` for each shift in turn, some shifts together; None where elimination does not do.

    A solution is given only if its true residual is within ``tolerance`` of its load and of the products that make it up.
    """
    turn = k.shape[1] < k.shape[2]
    if turn:
        k, m, b = _turned(k), _turned(m), b.transpose(0, 2, 1)
    inner = np.s_[:, HALO:-HALO, HALO:-HALO]
    lines = np.flatnonzero((m[4] > 0).any(axis=1)) - HALO
    cols = m.shape[2] - 2 * HALO
    if not len(lines) or cols > LINE or b[:, m[4] <= 0].any():
        yield from [None] * len(shifts)
        return
    here = np.s_[:, lines[0]:lines[-1] + 1]
    load = b[inner][here].transpose(1, 2, 0)[:, None]
    some = max(1, NUMBERS // (len(load) * cols * cols))
    for at in range(0, len(shifts), some):
        kappa, sigma = (np.array(v, dtype=float)[:, None] for v in zip(*shifts[at:at + some]))
        try:
            y = _eliminated(kappa * k[inner][here][:, :, None] + sigma * m[inner][here][:, :, None], load)
        except np.linalg.LinAlgError:
            yield from [None] * len(kappa)
            continue
        for s in range(len(kappa)):
            x = np.zeros_like(b)
            x[inner][here] = y[:, s].transpose(2, 0, 1)
            a = kappa[s, 0] * k + sigma[s, 0] * m
            size = np.sqrt((b * b).sum(axis=(1, 2))) + np.abs(a).sum(axis=0).max() * np.sqrt((x * x).sum(axis=(1, 2)))
            off = b - product(a, x)
            good = (np.sqrt((off * off).sum(axis=(1, 2))) <= tolerance * size).all()
            yield (x.transpose(0, 2, 1) if turn else x) if good else None
