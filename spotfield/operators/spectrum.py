"""Lowest eigenvalues of K v = lambda M v on tables of nodes.

A row is one node with its values of a block of vectors, as arrays, and its links
(the matrices' entries in its column).  Every round takes the products of the search
directions as sums over links, adds up the Gram matrices of all directions per task,
solves one small dense problem per component and mixes the arrays in place.  No task
holds a component, and all components advance in the same jobs until each has settled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialise

SETTLED, LEAST_ROUNDS = 1e-7, 15
KEYS = ["specimen", "component"]


def smallest_eigenvalues(entries: DataFrame, n_eigenvalues: int = 1, limit: int = 3000) -> DataFrame:
    """The smallest eigenvalues, negative ones included, per component: (specimen, component, rank, eigenvalue).

    A block of vectors descends on the Rayleigh quotient along preconditioned
    residuals and its last steps.  Minima of the quotient are eigenvalues of the
    lowest end only, so an indefinite K is found out whatever the start; one
    vector more than asked for has to settle too.  Raises if they do not settle.
    """
    block = n_eigenvalues + 3
    kinds = dict(entries.dtypes)
    keys = f"specimen {kinds['specimen']}, component {kinds['component']}"
    steps = materialise(_products(_start(entries, block), block), "eigen")
    scales = materialise(entries.where("i = j").groupBy(*KEYS).agg(
        F.max(F.abs("k") / F.greatest(F.abs("m"), F.lit(1e-300))).alias("scale"), F.count("*").alias("n_nodes")), "eigen-scale")
    ended = []
    for turn in range(limit):
        small = materialise(_small(steps, scales, block, n_eigenvalues, turn, keys), "eigen-small")
        ended.append(small.where("done"))
        if small.where("NOT done").isEmpty():
            break
        steps = materialise(_products(_mixed(steps, small.where("NOT done").drop("done", "found"), block), block), "eigen")
    else:
        raise RuntimeError("the smallest eigenvalues did not settle")
    out = ended[0]
    for one in ended[1:]:
        out = out.unionByName(one)
    return out.select(*KEYS, F.posexplode("found").alias("at", "eigenvalue")).select(*KEYS, (F.col("at") + 1).alias("rank"), "eigenvalue")


def _start(entries, block):
    """Nodes with their links, the inverse diagonal that steers, and first directions: constants and hashed values."""
    nodes = entries.groupBy(*KEYS, F.col("j").alias("node")).agg(
        F.collect_list(F.struct("i", "k", "m")).alias("links"),
        F.max(F.when(F.col("i") == F.col("j"), F.abs("k"))).alias("dk"), F.max(F.when(F.col("i") == F.col("j"), F.abs("m"))).alias("dm"))
    nodes = materialise(nodes, "eigen-nodes")
    top = nodes.groupBy(*KEYS).agg(F.max(F.col("dk") / F.greatest("dm", F.lit(1e-300))).alias("top"))
    zeros = F.array_repeat(F.lit(0.0), block)
    first = F.array(F.lit(1.0), *[F.xxhash64("node", F.lit(c)) / F.lit(2.0 ** 63) for c in range(1, block)])
    return nodes.join(top, KEYS).select(
        *KEYS, "node", "links", (F.lit(1.0) / (F.col("dk") + F.lit(1e-3) * F.greatest("top", F.lit(1e-300)) * F.col("dm") + F.lit(1e-300))).alias("inverse"),
        *[zeros.alias(c) for c in ("x", "kx", "mx", "p", "kp", "mp")], first.alias("w"))


def _products(state, block):
    """The state with K w and M w: one shuffle of sums over links, added up before it."""
    sent = state.select(*KEYS, "w", F.explode("links").alias("e"))
    sums = sent.groupBy(*KEYS, F.col("e.i").alias("node")).agg(
        *[F.sum(F.col(f"e.{q}") * F.col("w")[c]).alias(f"{q}{c}") for q in "km" for c in range(block)])
    sums = sums.select(*KEYS, "node", *[F.array(*[F.col(f"{q}{c}") for c in range(block)]).alias(f"{q}w") for q in "km"])
    return state.join(sums, [*KEYS, "node"]).select(
        *KEYS, "node", "links", "inverse", F.concat("x", "w", "p").alias("s"), F.concat("kx", "kw", "kp").alias("ks"), F.concat("mx", "mw", "mp").alias("ms"))


def _mixed(steps, small, block):
    """The next vectors, steps and directions from one round's coefficients."""
    def mix(ways, of):
        return F.transform(ways, lambda way: F.aggregate(F.zip_with(way, F.col(of), lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v))
    # the steps leave out the share of the old vectors, the first of each row of coefficients
    later = F.transform("ways", lambda way: F.concat(F.array_repeat(F.lit(0.0), block), F.slice(way, block + 1, 2 * block)))
    mixed = steps.join(small, KEYS).select(
        *KEYS, "node", "links", "inverse", "level",
        *[mix(F.col("ways"), of).alias(name) for name, of in (("x", "s"), ("kx", "ks"), ("mx", "ms"))],
        *[mix(later, of).alias(name) for name, of in (("p", "s"), ("kp", "ks"), ("mp", "ms"))])
    # residual, steered by the inverse diagonal
    off = F.zip_with("kx", F.zip_with("level", "mx", lambda a, b: a * b), lambda a, b: a - b)
    return mixed.withColumn("w", F.transform(off, lambda v: v * F.col("inverse"))).drop("level")


def _small(steps, scales, block, count, turn, keys):
    """One dense problem per component from Gram matrices: (.., done, found, level, ways)."""
    def gram(frames):
        held = {}
        for pdf in frames:
            for key, part in pdf.groupby(KEYS, sort=False):
                s, ks, ms = (np.stack(part[c]) for c in ("s", "ks", "ms"))
                residual = s[:, block:2 * block] / part["inverse"].to_numpy()[:, None]
                sums = np.concatenate([(s.T @ ks).ravel(), (s.T @ ms).ravel(), (residual ** 2).sum(axis=0), (ms[:, :block] ** 2).sum(axis=0)])
                held[key] = held[key] + sums if key in held else sums
        for key, sums in held.items():
            yield pd.DataFrame({"specimen": [key[0]], "component": [key[1]], "sums": [sums]})

    def solve(key, pdf):
        sums, scale, n = np.sum(np.stack(pdf["sums"]), axis=0), max(pdf["scale"].iloc[0], 1e-300), int(pdf["n_nodes"].iloc[0])
        w = 3 * block
        stiff, mass = sums[:w * w].reshape(w, w), sums[w * w:2 * w * w].reshape(w, w)
        residual, size = np.sqrt(sums[2 * w * w:2 * w * w + block]), np.sqrt(sums[2 * w * w + block:])
        value = np.diag(stiff)[:block] / np.maximum(np.diag(mass)[:block], 1e-300)
        off = np.where(size > 0, residual / (scale * np.maximum(size, 1e-300)), np.inf)
        asked, watched = min(count, n), min(count + 1, n)
        done = (turn > LEAST_ROUNDS or n <= w and turn > 2) and off[:asked].max() <= SETTLED and off[:watched].max() <= 1e3 * SETTLED
        ways, level = _ritz(stiff, mass, block)
        return pd.DataFrame({"specimen": [key[0]], "component": [key[1]], "done": [bool(done)], "found": [np.sort(value[:asked])], "level": [level], "ways": [[list(r) for r in ways.T]]})

    parts = steps.select(*KEYS, "inverse", "s", "ks", "ms").mapInPandas(gram, f"{keys}, sums array<double>")
    return parts.join(scales, KEYS).groupBy(*KEYS).applyInPandas(
        solve, f"{keys}, done boolean, found array<double>, level array<double>, ways array<array<double>>")


def _ritz(stiff, mass, block):
    """Coefficients of the best ``block`` vectors in the span, and their values; directions of no mass are left out."""
    size = np.sqrt(np.maximum(np.diag(mass), 0.0))
    unit = np.where(size > 0, 1.0 / np.where(size > 0, size, 1.0), 0.0)
    gram = (mass + mass.T) / 2 * unit[:, None] * unit
    share, turn = np.linalg.eigh(gram)
    kept = share > 1e-10 * share.max()
    basis = unit[:, None] * turn[:, kept] / np.sqrt(share[kept])
    value, y = np.linalg.eigh(basis.T @ ((stiff + stiff.T) / 2) @ basis)
    ways, level = np.zeros((len(stiff), block)), np.zeros(block)
    found = min(block, len(value))
    ways[:, :found], level[:found] = basis @ y[:, :found], value[:found]
    return ways, level
