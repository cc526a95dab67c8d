"""Shortest paths along the edges of one tile of a triangulated lattice.

Every edge is a side of a cell or its diagonal, so a length is a number of sides and
a number of diagonals.  Both are kept as whole numbers: distances are exact, and equal
distances have equal numbers, whichever path and whichever tile they come from.

Arrays cover the tile's own nodes and a rim of one node; the rim belongs to the
neighbours.  ``labels`` has the component of each cell between those nodes, or -1.
"""

from __future__ import annotations

import numpy as np

ROOT = 2.0 ** 0.5
UNREACHED = -1
STEPS = [(0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (-1, -1), (1, -1), (-1, 1)]


def lengths(sides, diagonals):
    """In units of the lattice spacing; infinite where no path is known yet."""
    return np.where(sides < 0, np.inf, sides + diagonals * ROOT)


def node_labels(labels):
    """Component of every node, from the cells around it."""
    out = np.full((labels.shape[0] + 1, labels.shape[1] + 1), -1, dtype=labels.dtype)
    for r in (0, 1):
        for c in (0, 1):
            part = out[r:r + labels.shape[0], c:c + labels.shape[1]]
            np.maximum(part, labels, out=part)
    return out


def links(labels, top: int, left: int):
    """For each of ``STEPS``: whether an edge leads that way from a node.

    ``top`` and ``left`` are the lattice row and column of the first cell; the
    diagonal of a cell runs down to the right where their sum is even.
    """
    cell = labels >= 0
    rows, cols = cell.shape
    along = np.zeros((rows + 1, cols), dtype=bool)  # node to its right neighbour
    along[:-1] |= cell
    along[1:] |= cell
    down = np.zeros((rows, cols + 1), dtype=bool)
    down[:, :-1] |= cell
    down[:, 1:] |= cell
    even = (np.add.outer(np.arange(rows) + top, np.arange(cols) + left) % 2) == 0
    out = np.zeros((len(STEPS), rows + 1, cols + 1), dtype=bool)
    out[0, :, :-1], out[1, :, 1:] = along, along
    out[2, :-1, :], out[3, 1:, :] = down, down
    out[4, :-1, :-1], out[5, 1:, 1:] = cell & even, cell & even
    out[6, :-1, 1:], out[7, 1:, :-1] = cell & ~even, cell & ~even
    return out


def relax(leads, sides, diagonals, start):
    """Lower the distances of the tile's own nodes, from the nodes ``start`` on, until none falls; returns the nodes that fell.

    Nodes are flat indices.  Rim nodes keep their values.
    """
    shape = sides.shape
    width = shape[1]
    own = np.zeros(shape, dtype=bool)
    own[1:-1, 1:-1] = True
    own = own.ravel()
    flat = [lead.ravel() for lead in leads]
    a, b = sides.ravel(), diagonals.ravel()
    value = lengths(a, b)
    fell = np.zeros(a.size, dtype=bool)
    active = np.unique(start)
    while active.size:
        again = []
        for (dr, dc), lead in zip(STEPS, flat):
            at = active[lead[active]]
            to = at + dr * width + dc
            mine = own[to]
            at, to = at[mine], to[mine]
            slant = int(dr != 0 and dc != 0)
            na, nb = a[at] + 1 - slant, b[at] + slant
            nv = na + nb * ROOT
            less = nv < value[to]
            to = to[less]
            a[to], b[to], value[to] = na[less], nb[less], nv[less]
            again.append(to)
        active = np.unique(np.concatenate(again))
        fell[active] = True
    sides[:], diagonals[:] = a.reshape(shape), b.reshape(shape)
    return np.flatnonzero(fell)


def told(leads, nodes):
    """(row direction, column direction, nodes) for each neighbour that an edge leads to from ``nodes``, which are the tile's own."""
    rows, cols = leads.shape[1:]
    r, c = np.divmod(nodes, cols)
    found: dict = {}
    for (dr, dc), lead in zip(STEPS, leads):
        p, q = r + dr, c + dc
        up = (p == rows - 1).astype(int) - (p == 0)
        side = (q == cols - 1).astype(int) - (q == 0)
        out = lead[r, c] & ((up != 0) | (side != 0))
        for u, s in set(zip(up[out].tolist(), side[out].tolist())):
            found.setdefault((u, s), []).append(nodes[out & (up == u) & (side == s)])
    return [(u, s, np.unique(np.concatenate(parts))) for (u, s), parts in found.items()]
