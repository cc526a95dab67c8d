"""Clusters against plain k-means in Python integers, and the bound against random points."""

import hashlib
import math

import numpy as np
import pytest

from spotfield.llm import centroids as C

SCHEMA = "vec_id long, embedding array<float>, cluster string"


def plain(rows, k, rounds, dimension):
    kept = []
    for i, e, _ in rows:
        if e is not None and len(e) == dimension and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [max(-2**63, min(2**63 - 1, math.floor(256 * float(np.float32(x))))) for x in e]))
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    now = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        now = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(now)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    whole = {}
    for _, c, d in found:
        whole[c] = whole.get(c, 0) + d
    top = 2**63 - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, min(d, top), min(whole[c], top), min(sum(whole.values()), top), sha[c]) for i, c, d in found), key=repr)


def data(seed, n, dimension, spread):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, spread, (7, dimension))
    rows = [(i, [float(np.float32(x)) for x in middles[i % 7] + rng.normal(0, 0.1, dimension)], "own") for i in range(n)]
    rows += [(3, rows[3][1], "own")] * 40 + [(None, rows[5][1], "own"), (n, None, "x"), (n + 1, [0.5] * (dimension - 1), "x"), (n + 2, [None] * dimension, "x")]
    rows += [(n + 3, [float("nan")] * dimension, "x"), (n + 4, [float("inf")] * dimension, "x"), (n + 5, [], "x"), (n + 6, [0.0] * dimension, "x")]
    return rows


@pytest.mark.parametrize("seed,n,dimension,spread,k", [(0, 400, 3, 0.05, 12), (1, 300, 8, 1.0, 40), (2, 60, 2, 0.0, 100), (3, 120, 3, 3e5, 9), (4, 60, 2, 1e20, 5)])
def test_clusters_are_those_of_plain_kmeans(spark, monkeypatch, seed, n, dimension, spread, k):
    monkeypatch.setattr(C, "PACK", 50)
    rows = data(seed, n, dimension, spread)
    got = C.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k=k, rounds=5, dimension=dimension)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, k, 5, dimension)


def test_loss_bounds_every_point_of_a_sphere():
    rng = np.random.default_rng(5)
    less = 0
    for dimension in (2, 3, 16):
        for _ in range(40):
            old = rng.integers(-50, 50, (6, dimension))
            new = old + rng.integers(-9, 9, old.shape)
            radii = rng.uniform(0, 40, 6)
            move, loss = C.tightened(old.tolist(), new.tolist(), radii)
            x = rng.normal(size=(3000, dimension))
            x *= (rng.random(3000) ** 0.2 / np.linalg.norm(x, axis=1))[:, None]
            for i in range(6):
                p = old[i] + radii[i] * x
                gain = np.linalg.norm(p[:, None] - old, axis=2) - np.linalg.norm(p[:, None] - new, axis=2)
                assert np.delete(gain, i, 1).max() <= loss[i]
                less += loss[i] < 0.99 * np.delete(move, i).max()
    assert less > 200  # the spheres tell more than the moves alone


def test_most_vectors_are_not_scanned_again(spark):
    rows = data(7, 2000, 8, 1.0)
    trace = []
    C.cluster(spark.createDataFrame(rows, SCHEMA), k=7, rounds=5, dimension=8, trace=trace).count()
    assert trace[0] == 2042 and len(trace) == 6 and sum(trace[2:]) < trace[0]


def test_empty_tables(spark):
    none = spark.createDataFrame([(1, None, "x"), (2, [float("nan")], "x")], SCHEMA)
    assert C.cluster(none).collect() == [] and C.cluster(none.where("vec_id < 0")).count() == 0
