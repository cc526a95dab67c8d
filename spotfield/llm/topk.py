"""Exact top-k inner products with block-at-a-time pruning.

Vectors are dealt over shards by range of (strongest components, id), so that
neighbours in a shard look alike, and cut into blocks.  A block keeps the largest
and smallest value of every component, whose products with a query's
components, summed, bound all scores in the block.  Each query visits the
blocks of a shard in the order of their bounds and scores them whole, through
the block's forward index, until the next bound falls below its k-th score so
far; a bound equal to it is still visited, as ties go to the smaller id.

Shards are ordered for every query in the same way, by the bounds of their own
largest and smallest values, which are a small table: packs of up to ``PACK``
shards' bounds meet sets of up to ``QUERIES`` queries.  The best ``FIRST`` shards
of a query give it a k-th score; then only shards whose bound still reaches that
score are visited, and their blocks start from it.  A shard's queries are dealt
in sets, so a shard that all queries ask for is work for many tasks.  The best k
per query and shard meet in a last, small, sort.

Defined cases: rows with a null id, a null vector, or a null or non-finite
component take no part; a shorter vector counts as padded with zeros; of rows
that repeat a query's id one vector asks (the largest), and none of them is its
candidate; rows that repeat another id are candidates each; an empty table, or
one without queries, gives an empty result; other columns are ignored.
Scores are exact; beyond 53 bits Python integers are used, and what a long cannot hold becomes its nearest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, ship_package

SHARD, QUERIES, BLOCK, PACK, FIRST = 4096, 1024, 64, 1024, 3
LONG = (-(1 << 63), (1 << 63) - 1)
PACKED = "ids binary, width int, cells binary, high array<long>, low array<long>"


def whole_numbers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, cells array<long>) of the rows that take part; ``vectors`` has vec_id and embedding."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("cells"))


def _dense(cells: pa.ListArray) -> np.ndarray:
    """Rows of whole numbers, shorter ones padded with zeros."""
    lengths = np.diff(cells.offsets.to_numpy())
    m = np.zeros((len(lengths), int(lengths.max(initial=0))), dtype=np.int64)
    m[np.arange(m.shape[1]) < lengths[:, None]] = cells.flatten().to_numpy(zero_copy_only=False)
    return m


def _widened(*matrices):
    width = max(m.shape[1] for m in matrices)
    return [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


def _packed(batches, limit: int):
    """One row for up to ``limit`` vectors of the partition."""
    ids, rows = [], []
    for batch in batches:
        ids.append(batch.column(0).to_numpy())
        rows.append(_dense(batch.column(1)))
    if not ids:
        return
    ids, m = np.concatenate(ids), np.concatenate(_widened(*rows))
    for at in range(0, len(ids), limit):
        part = m[at:at + limit]
        yield pa.RecordBatch.from_pydict({
            "ids": pa.array([ids[at:at + limit].tobytes()], pa.binary()), "width": pa.array([m.shape[1]], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary()),
            "high": pa.array([part.max(axis=0)], pa.list_(pa.int64())), "low": pa.array([part.min(axis=0)], pa.list_(pa.int64()))})


def _unpacked(ids: bytes, width: int, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, dtype=np.int64)
    return i, np.frombuffer(cells, dtype=np.int64).reshape(len(i), width)


def _kind(queries, *rows):
    """A number type in which the products are exact."""
    largest = int(np.abs(queries.astype(float)).max(initial=0)) * max(int(np.abs(r.astype(float)).max(initial=0)) for r in rows) * max(queries.shape[1], 1)
    return np.float64 if largest < 1 << 53 else object


def _bounds(queries, high, low):
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def _floors(least, kind):
    """Scores to reach; the least long stands for none."""
    return np.where(least == LONG[0], -np.inf, least.astype(kind))


def search(query_ids, queries, ids, rows, k: int, block: int = BLOCK, least=None):
    """(query index, id, score) of the ``k`` best rows of each query among ``rows``; scores below ``least`` may be left out."""
    queries, rows = _widened(queries, rows)
    kind = _kind(queries, rows)
    queries, rows = queries.astype(kind), rows.astype(kind)
    floor = np.full(len(queries), -np.inf) if least is None else _floors(least, kind)
    starts = np.arange(0, len(ids), block)
    high, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
    bounds = _bounds(queries, high, low)
    turn = np.argsort(-bounds, axis=1, kind="stable")
    n = len(queries)
    none = np.iinfo(np.int64).max
    best, names = np.full((n, k), -np.inf, dtype=kind), np.full((n, k), none, dtype=np.int64)
    active = np.arange(n)
    for r in range(len(starts)):
        bound = bounds[active, turn[active, r]]
        active = active[(bound >= best[active, k - 1]) & (bound >= floor[active])]
        if not len(active):
            break
        visited = turn[active, r]
        for b in np.unique(visited):
            q = active[visited == b]
            part = slice(starts[b], starts[b] + block)
            score = queries[q] @ rows[part].T
            name = np.broadcast_to(ids[part], score.shape)
            score = np.where(name == query_ids[q][:, None], -np.inf, score)
            all_scores, all_names = np.concatenate([best[q], score], axis=1), np.concatenate([names[q], name], axis=1)
            top = np.lexsort((all_names, -all_scores), axis=1)[:, :k]
            best[q], names[q] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_names, top, 1)
    found = best > -np.inf
    return np.nonzero(found)[0], names[found], np.clip(best[found], *LONG).astype(np.int64) if kind is object else best[found].astype(np.int64)


def _asked(asks: pa.StructArray):
    """(ids, floors, vectors) of a set of queries."""
    return asks.field("query_id").to_numpy(), asks.field("least").to_numpy(), _dense(asks.field("cells"))


def _reached(asking: DataFrame, packs: DataFrame, n_sets: int, n_packs: int, first: int | None) -> DataFrame:
    """(query_id, shard, bound): the ``first`` shards of each query and pack by bound, or all that reach its floor."""
    sets = _in_sets(asking, n_sets).select("asks")
    cells = sets.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(n_packs - 1)))).join(packs, "pack").select("asks", "bounds")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                names, least, queries = _asked(batch.column(0)[r].values)
                bounds = batch.column(1)[r].values
                shards = bounds.field("shard").to_numpy()
                queries, high, low = _widened(queries, _dense(bounds.field("high")), _dense(bounds.field("low")))
                kind = _kind(queries, high, low)
                b = _bounds(queries.astype(kind), high.astype(kind), low.astype(kind))
                if first is None:
                    q, s = np.nonzero(b >= _floors(least, kind)[:, None])
                else:
                    s = np.argsort(-b, axis=1, kind="stable")[:, :first]
                    q, s = np.repeat(np.arange(len(names)), s.shape[1]), s.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(shards[s]), pa.array(b[q, s].astype(float))], ["query_id", "shard", "bound"])

    return cells.mapInArrow(run, "query_id long, shard long, bound double")


def _in_sets(asking: DataFrame, n_sets: int, *keys: str) -> DataFrame:
    """Queries of (query_id, least, cells) as arrays of about ``QUERIES`` at most, by the keys too."""
    dealt = asking.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(n_sets)))
    return dealt.groupBy(*keys, "part").agg(F.collect_list(F.struct("query_id", "least", "cells")).alias("asks"))


def _found(probes: DataFrame, asking: DataFrame, packed: DataFrame, n_sets: int, k: int) -> DataFrame:
    """The best ``k`` of every (query_id, shard) asked for: (query_id, vec_id, score)."""
    sets = _in_sets(probes.select("query_id", "shard").join(asking, "query_id"), n_sets, "shard")

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                names, least, queries = _asked(batch.column(0)[r].values)
                ids, rows = _unpacked(*[batch.column(c)[r].as_py() for c in (1, 2, 3)])
                q, name, score = search(names, queries, ids, rows, k, least=least)
                yield pa.RecordBatch.from_arrays([pa.array(names[q]), pa.array(name), pa.array(score)], ["query_id", "vec_id", "score"])

    return sets.join(packed, "shard").select("asks", "ids", "width", "cells").mapInArrow(run, "query_id long, vec_id long, score long")


def top(vectors: DataFrame, asks: Column, k: int = 5, trace: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of (vec_id, embedding) that ``asks`` is true of.

    ``trace``, if given, is told how many (query, shard) pairs were visited, and of how many.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = whole_numbers(vectors)
    # strongest components first: rows of a block share them
    size = F.array_max(F.transform("cells", lambda x: F.abs(x)))
    kept = kept.withColumn("strong", F.array_position(F.transform("cells", lambda x: F.abs(x)), size)).withColumn("sign", F.get("cells", F.col("strong").cast("int") - 1) > 0)
    kept = materialise(kept, "cells")
    place = [F.col("strong"), F.col("sign"), F.get("cells", F.lit(0)), F.col("vec_id")]
    packed = kept.repartitionByRange(max(1, -(-kept.count() // SHARD)), *place).sortWithinPartitions(*place)
    packed = packed.select("vec_id", "cells").mapInArrow(lambda b: _packed(b, SHARD), PACKED)
    packed = materialise(packed.withColumn("shard", F.monotonically_increasing_id()), "shards")
    n_shards = packed.count()
    n_packs = max(1, -(-n_shards // PACK))
    packs = packed.withColumn("pack", F.pmod(F.xxhash64("shard"), F.lit(n_packs)).cast("int")).groupBy("pack").agg(
        F.collect_list(F.struct("shard", "high", "low")).alias("bounds"))
    asking = kept.where(asks).groupBy(F.col("vec_id").alias("query_id")).agg(F.max("cells").alias("cells"))
    asking = materialise(asking.select("query_id", F.lit(LONG[0]).alias("least"), "cells"), "asking")
    n_queries = asking.count()
    n_sets = max(1, -(-n_queries // QUERIES))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    turn = Window.partitionBy("query_id").orderBy(F.desc("bound"), "shard")
    first = _reached(asking, packs, n_sets, n_packs, FIRST).withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= FIRST)
    first = materialise(first.select("query_id", "shard"), "first")
    few = materialise(_found(first, asking, packed, n_sets, k), "few")
    floors = few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
    aware = asking.join(floors, "query_id", "left").select("query_id", F.coalesce("floor", "least").alias("least"), "cells")
    aware = materialise(aware, "aware")
    rest = _reached(aware, packs, n_sets, n_packs, None).join(first, ["query_id", "shard"], "left_anti")
    if trace is not None:
        rest = materialise(rest, "rest")
        trace.append((first.count() + rest.count(), n_queries * n_shards))
    few = few.unionByName(_found(rest, aware, packed, n_sets, k))
    return few.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
