"""Exact k-means over whole numbers, with geometric tightening of the drift.

Vectors are packed into rows of up to ``PACK`` of them, with an upper bound of each
one's distance to its centroid and a lower bound of the distances to all others.
When centroids move, the upper bound grows by the own centroid's move.  The lower
bound shrinks by less than the others' full moves: all vectors of cluster i lie in
a sphere round its old centroid, and for every point x of a sphere

    |x - old_j| - |x - new_j|  <=  |new_j - old_j| * cos(angle at the midpoint of
    old_j and new_j between the move and x),

which in the plane of the sphere's centre and the move is largest on the tangent
from that midpoint: move * cos(max(0, angle to the centre - asin(radius / distance
of the centre))), nothing beyond a right angle, and the full move if the sphere
holds the midpoint.  Where the bounds still part, a vector keeps its cluster; every other is
scanned against all centroids in exact whole numbers.

Each round reads and writes the packed rows once; a task adds one row with the sums
of its vectors by cluster, which are then added up natively.  Only the k centroids, their sums
and radii pass through the driver: k times the dimension, whatever the input.

Defined cases: vectors that are null, of another length, or hold a null or
non-finite component take no part; a null vec_id counts as the empty text in the
hash and is kept; rows that share a vec_id are vectors each; equal hashes go by
the components; with fewer kept vectors than k all are centroids; an empty table
gives an empty result; other columns are ignored.  What a long cannot hold
(components, distances, sums) becomes its nearest; sums for centroids are exact.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, ship_package

CLUSTERS, ROUNDS, DIMENSION, SCALE = 40, 5, 64, 256
PACK = 4096
SLACK = 1e-9  # relative, far above the rounding of the bounds
ANGLE_SLACK = 1e-7  # an arc cosine near one keeps half of the digits
LARGEST = (1 << 63) - 1
STATE = "ids binary, named binary, width int, cells binary, mine binary, upper binary, lower binary, scanned long, totals array<struct<cluster: int, part: int, total: decimal(38,0)>>, radii array<double>"


def kept_vectors(vectors: DataFrame, dimension: int = DIMENSION, scale: int = SCALE) -> DataFrame:
    """(vec_id, cells array<long>) of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") == dimension) & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("cells"))


def first_centroids(kept: DataFrame, k: int = CLUSTERS) -> list[list[int]]:
    name = F.sha2(F.concat(F.lit("2:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return [list(r.cells) for r in kept.select(name.alias("name"), "cells").orderBy("name", "cells").limit(k).collect()]


def squared_distances(cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact, as doubles where these suffice and Python integers otherwise."""
    largest = max(int(np.abs(cells.astype(float)).max(initial=0)), int(np.abs(centroids.astype(float)).max(initial=0)))
    if 4 * max(cells.shape[1], 1) * (largest + 1) ** 2 < 1 << 53:
        x, c = cells.astype(float), centroids.astype(float)
        return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    x, c = cells.astype(object), centroids.astype(object)
    return np.stack([((x - one) ** 2).sum(axis=1) for one in c], axis=1)


def own_distances(cells: np.ndarray, centroids: np.ndarray, mine: np.ndarray) -> np.ndarray:
    largest = max(int(np.abs(cells.astype(float)).max(initial=0)), int(np.abs(centroids.astype(float)).max(initial=0)))
    kind = np.int64 if 4 * max(cells.shape[1], 1) * (largest + 1) ** 2 < 1 << 62 else object
    apart = cells.astype(kind) - centroids.astype(kind)[mine]
    return (apart * apart).sum(axis=1)


def tightened(old, new, radii: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own move of each cluster, most that a lower bound in each cluster loses to the others' moves)."""
    old, new = np.array(old, dtype=object), np.array(new, dtype=object)  # differences of whole numbers are exact
    step = (new - old).astype(float)
    move = np.sqrt((step ** 2).sum(axis=1))
    to_centre = (2 * old[:, None, :] - (new + old)[None, :, :]).astype(float) / 2  # [i, j]: from j's midpoint to the centre of sphere i
    far = np.sqrt((to_centre ** 2).sum(axis=2))
    along = (to_centre * step[None, :, :]).sum(axis=2)
    outside = (far > radii[:, None]) & (move > 0)[None, :]
    safe = np.where(outside, far, 1.0)
    angle = np.arccos(np.clip(along / (safe * np.where(move > 0, move, 1.0)), -1, 1))
    half = np.arcsin(np.clip(np.where(outside, radii[:, None], 0.0) / safe, 0, 1))
    least = np.maximum(angle - half - ANGLE_SLACK, 0)
    loss = np.where(outside, move * np.maximum(np.cos(least), 0), move[None, :])
    np.fill_diagonal(loss, 0)
    return move * (1 + SLACK), loss.max(axis=1, initial=0) * (1 + SLACK)


def assign(cells, mine, upper, lower, centroids):
    """New (mine, upper, lower) and the number of vectors that were scanned."""
    mine, upper, lower = mine.copy(), upper.copy(), lower.copy()
    open_ = np.flatnonzero(upper * (1 + SLACK) >= lower * (1 - SLACK))
    if len(open_):
        upper[open_] = np.sqrt(own_distances(cells[open_], centroids, mine[open_]).astype(float))
        open_ = open_[upper[open_] * (1 + SLACK) >= lower[open_] * (1 - SLACK)]
    for at in range(0, len(open_), 1024):
        part = open_[at:at + 1024]
        d = squared_distances(cells[part], centroids)
        best = d.argmin(axis=1)  # the first of equal ones
        rows = np.arange(len(part))
        mine[part], upper[part] = best, np.sqrt(d[rows, best].astype(float))
        d = d.astype(float)
        d[rows, best] = np.inf
        lower[part] = np.sqrt(d.min(axis=1))
    return mine, upper, lower, len(open_)


TOTALS = pa.list_(pa.struct([("cluster", pa.int32()), ("part", pa.int32()), ("total", pa.decimal128(38, 0))]))
KINDS = [("ids", pa.binary()), ("named", pa.binary()), ("width", pa.int32()), ("cells", pa.binary()), ("mine", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()),
         ("scanned", pa.int64()), ("totals", TOTALS), ("radii", pa.list_(pa.float64()))]


def _record(**values) -> pa.RecordBatch:
    cells = {k: v.tobytes() if isinstance(v, np.ndarray) else v for k, v in values.items()}
    return pa.RecordBatch.from_arrays([pa.array([cells.get(name)], kind) for name, kind in KINDS], names=[name for name, _ in KINDS])


class Sums:
    """Sums of a task's vectors by cluster, and the radii of their spheres."""

    def __init__(self, k: int, dimension: int):
        self.sums, self.counts = np.zeros((k, dimension), dtype=object), [0] * k
        self.radii, self.scanned = np.zeros(k), 0

    def add(self, cells, mine, upper, scanned):
        kind = np.int64 if int(np.abs(cells.astype(float)).max(initial=0)) * max(len(cells), 1) < 1 << 62 else object
        order = np.argsort(mine, kind="stable")
        starts = np.searchsorted(mine[order], np.arange(len(self.radii) + 1))
        for c in np.unique(mine):
            rows = order[starts[c]:starts[c + 1]]
            self.radii[c] = max(self.radii[c], upper[rows].max())
            self.sums[c] += cells[rows].astype(kind).sum(axis=0).astype(object)
            self.counts[c] += len(rows)
        self.scanned += scanned

    def record(self) -> pa.RecordBatch:
        """Each cluster's sums by component, and its count under -1."""
        totals = []
        for c, n in enumerate(self.counts):
            if n:
                totals += [{"cluster": c, "part": j, "total": Decimal(int(v))} for j, v in enumerate(self.sums[c])]
                totals.append({"cluster": c, "part": -1, "total": Decimal(n)})
        return _record(scanned=self.scanned, totals=totals, radii=self.radii.tolist())


def _packed(ids, named, cells, mine, upper, lower) -> pa.RecordBatch:
    return _record(ids=ids, named=named, width=cells.itemsize, cells=cells, mine=mine.astype(np.int16), upper=upper, lower=lower)


def _narrow(cells: np.ndarray) -> np.ndarray:
    for kind in (np.int16, np.int32):
        if len(cells) and np.iinfo(kind).min <= cells.min() and cells.max() <= np.iinfo(kind).max:
            return cells.astype(kind)
    return cells


def _unpacked(row, dimension):
    cells = np.frombuffer(row["cells"], dtype=f"<i{row['width']}").reshape(-1, dimension)
    return (np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["named"], dtype=np.bool_), cells,
            np.frombuffer(row["mine"], dtype=np.int16).astype(np.int64), np.frombuffer(row["upper"]), np.frombuffer(row["lower"]))


def _start(kept: DataFrame, centroids: np.ndarray, dimension: int) -> DataFrame:
    """Packed rows after the first assignment, in which every vector is scanned."""
    k = len(centroids)

    def run(batches):
        sums = Sums(k, dimension)
        for batch in batches:
            for at in range(0, batch.num_rows, PACK):
                part = batch.slice(at, PACK)
                ids = part.column(0)
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                cells = _narrow(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension))
                n = len(cells)
                mine, upper, lower, scanned = assign(cells, np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n), centroids)
                sums.add(cells, mine, upper, scanned)
                yield _packed(ids.fill_null(0).to_numpy(), named, cells, mine, upper, lower)
        yield sums.record()

    return kept.mapInArrow(run, STATE)


def _vectors(state: DataFrame) -> DataFrame:
    return state.where("cells IS NOT NULL").select("ids", "named", "width", "cells", "mine", "upper", "lower")


def _round(state: DataFrame, centroids: np.ndarray, move: np.ndarray, loss: np.ndarray, dimension: int) -> DataFrame:
    k = len(centroids)

    def run(batches):
        sums = Sums(k, dimension)
        for batch in batches:
            for row in batch.to_pylist():
                ids, named, cells, mine, upper, lower = _unpacked(row, dimension)
                mine, upper, lower, scanned = assign(cells, mine, upper + move[mine], lower - loss[mine], centroids)
                sums.add(cells, mine, upper, scanned)
                yield _packed(ids, named, cells, mine, upper, lower)
        yield sums.record()

    return _vectors(state).mapInArrow(run, STATE)


def _moved(state: DataFrame, centroids: list[list[int]]) -> tuple[list[list[int]], np.ndarray, int]:
    """New centroids, the radius of each cluster round its old one, and how many vectors were scanned."""
    state = state.where("totals IS NOT NULL").select("totals", "radii", "scanned")
    totals = state.select(F.explode("totals").alias("t")).groupBy("t.cluster", "t.part").agg(F.sum("t.total").alias("total")).collect()
    radii = state.select(F.posexplode("radii").alias("cluster", "r")).groupBy("cluster").agg(F.max("r").alias("r")).collect()
    sums = {(r.cluster, r.part): int(r.total) for r in totals}
    new = [[sums[c, j] // sums[c, -1] for j in range(len(row))] if (c, -1) in sums else row for c, row in enumerate(centroids)]
    widest = np.zeros(len(centroids))
    for r in radii:
        widest[r.cluster] = r.r
    return new, widest * (1 + SLACK), state.agg(F.sum("scanned")).first()[0] or 0


def assigned(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, trace: list | None = None):
    """((vec_id, cluster, distance) per kept row, final centroids); ``trace`` receives the number of scanned vectors by assignment."""
    ship_package(vectors.sparkSession)
    kept = kept_vectors(vectors.select("vec_id", "embedding"), dimension, scale)
    centroids = first_centroids(kept, k)
    nothing = kept.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    if not centroids:
        return nothing, []
    state = materialise(_start(kept, np.array(centroids), dimension), "start")
    for _ in range(rounds):
        new, radii, scanned = _moved(state, centroids)
        if trace is not None:
            trace.append(scanned)
        move, loss = tightened(centroids, new, radii)
        state = materialise(_round(state, np.array(new), move, loss, dimension), "round")
        centroids = new
    if trace is not None:
        trace.append(state.agg(F.sum("scanned")).first()[0])
    last = np.array(centroids)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, named, cells, mine, _, _ = _unpacked(row, dimension)
                d = own_distances(cells, last, mine)
                if d.dtype == object:
                    d = np.array([min(v, LARGEST) for v in d], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~named), pa.array(mine.astype(np.int32)), pa.array(d)], ["vec_id", "cluster", "distance"])

    return _vectors(state).mapInArrow(run, "vec_id long, cluster int, distance long"), centroids


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimension: int = DIMENSION, scale: int = SCALE, trace: list | None = None) -> DataFrame:
    """Per kept row: (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    rows, centroids = assigned(vectors, k, rounds, dimension, scale, trace)
    rows = materialise(rows, "assigned")
    whole = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    names = [(c, min(whole.get(c, 0), LARGEST), min(sum(whole.values()), LARGEST), ",".join(map(str, row))) for c, row in enumerate(centroids)]
    named = spark.createDataFrame(names, "cluster int, cluster_inertia long, inertia long, body string")
    named = named.select("cluster", "cluster_inertia", "inertia", F.sha2(F.col("body").cast("binary"), 256).alias("centroid_sha256"))
    return rows.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
