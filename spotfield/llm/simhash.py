"""SimHash near duplicates by the generalised pigeonhole principle.

1. Each text gets a 64-bit fingerprint of its word shingles; equal
   fingerprints become one row with the smallest id and their number.
2. Bits that correlate over all fingerprints are grouped into partitions.
3. Two fingerprints within ``distance`` bits agree, in at least one partition
   i, up to t_i bits, whenever the sum of (t_i + 1) is distance + 1.  For each
   fingerprint a dynamic program picks the thresholds t_i (-1: skip) with the
   lowest estimated number of signatures and candidates.  The estimate comes
   from a histogram of each partition's leading bits, of fixed size.
4. Fingerprints are indexed by their value in each partition and probe all
   values within t_i; candidates are verified on all 64 bits.  A bucket that
   holds many fingerprints is split, and those that probe it visit each part.
5. Each task reduces its links to a forest before it returns them, so a large
   group of near copies gives one link a member, not one a pair.

Thresholds only steer the work: every pair within ``distance`` is found
whatever they are.

Defined cases: a null text counts as empty; a text without words has
fingerprint zero and links like any other; rows with a null id take part and
get the component of their fingerprint; a component without any id has a null
component_id; repeated rows give a row each; an empty table gives an empty
result; other columns are ignored by ``assign`` and kept by ``survivors``.
"""

from __future__ import annotations

from itertools import repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialise, ship_package
from .graph import components

WORDS, DISTANCE, SEED = 4, 4, 42
PARTITIONS = 3       # of about 21 bits: buckets stay small to tens of millions of texts; 2 for billions
COARSE = 10          # leading bits of a partition in its histogram
VERIFY_COST = 0.25   # of a candidate, in signatures
BUCKET = 16_384      # fingerprints of one bucket in one task
PAIRS = 1 << 21      # candidates verified at a time


def fingerprint(body: bytes, words: int = WORDS) -> int:
    parts = body.lower().split()  # bytes: ASCII letters and white space only
    if not parts:
        return 0
    n = len(parts) - words + 1
    shingles = map(b" ".join, zip(*(parts[i:] for i in range(words)))) if n > 0 else [b" ".join(parts)]
    n = max(n, 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at:at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(b, words) for b in batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    ship_package(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    return docs.select("doc_id", body).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def _counted(fps: DataFrame, count) -> dict[int, int]:
    """Sum of ``count(values) -> array`` over all rows; the array has a fixed length, whatever the input."""

    def run(batches):
        total = 0
        for batch in batches:
            if batch.num_rows:
                total = total + count(batch.column(0).to_numpy().view(np.uint64))
        if isinstance(total, np.ndarray):
            cells = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    return {r.cell: r.n for r in rows}


def _bits(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _both_set(values: np.ndarray) -> np.ndarray:
    total = np.zeros((64, 64))
    for at in range(0, len(values), 1 << 16):
        b = _bits(values[at:at + (1 << 16)]).astype(np.float32)  # sums of up to 65536 ones are exact
        total += b.T @ b
    return total.astype(np.int64).ravel()


def ball(width: int, radius: int) -> int:
    return sum(comb(width, k) for k in range(radius + 1))


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` partitions of the 64 bits; each grows from the most correlated pair left by the bit closest to it."""
    p = np.diag(both) / n
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / n - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        sub = corr[np.ix_(left, left)]
        group = [left[int(np.argmax(sub.max(axis=1)))]]
        while len(group) < width:
            rest = [b for b in left if b not in group]
            group.append(rest[int(np.argmax(corr[np.ix_(rest, group)].mean(axis=1)))])
        left = [b for b in left if b not in group]
        out.append(group)
    return out


def project(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.uint64)
    for j, b in enumerate(bits):
        out |= ((values >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
    return out


def candidate_table(histogram: np.ndarray, width: int, units: int) -> np.ndarray:
    """[u, cell]: estimated candidates of threshold u - 1, the bits below the histogram's taken as even."""
    coarse = int(np.log2(len(histogram)))
    cells = np.arange(len(histogram))
    rings = [histogram.astype(float)]
    for s in range(1, units):
        # walks of one more flip, without those that step back
        ring = sum(rings[s - 1][cells ^ (1 << j)] for j in range(coarse))
        if s > 1:
            ring = ring - (coarse - s + 2) * rings[s - 2]
        rings.append(ring / s)
    fine = width - coarse
    table = np.zeros((units + 1, len(histogram)))
    for u in range(1, units + 1):
        table[u] = sum(rings[s] * ball(fine, u - 1 - s) for s in range(u)) / 2.0**fine
    return table


def allocate(costs: list[np.ndarray], units: int) -> np.ndarray:
    """costs[i][u, row]: cost of giving u units to partition i.  (rows, partitions) units of least total cost."""
    rows = costs[0].shape[1]
    best = np.full((units + 1, rows), np.inf)
    best[0] = 0
    picks = []
    for cost in costs:
        new, pick = np.full_like(best, np.inf), np.zeros(best.shape, dtype=np.int8)
        for total in range(units + 1):
            for u in range(total + 1):
                c = best[total - u] + cost[u]
                better = c < new[total]
                new[total] = np.where(better, c, new[total])
                pick[total] = np.where(better, u, pick[total])
        best = new
        picks.append(pick)
    out = np.zeros((rows, len(costs)), dtype=np.int8)
    left, at = np.full(rows, units), np.arange(rows)
    for i in reversed(range(len(costs))):
        out[:, i] = picks[i][left, at]
        left = left - out[:, i]
    return out


def _masks(width: int, radius: int) -> np.ndarray:
    """All non-zero flips of up to ``radius`` of ``width`` bits."""
    out, ring = [], {0}
    for _ in range(radius):
        ring = {v ^ (1 << j) for v in ring for j in range(width) if not v >> j & 1}
        out += sorted(ring)
    return np.array(out, dtype=np.uint64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with node <> root of the graph of these links."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


DATA, PROBE, OWN = 0, 1, 2  # OWN: a member that probes its own bucket


def _verify(keys, fps, kinds, distance):
    """Forest of the links found in whole, sorted buckets."""
    stored, asking = kinds != PROBE, kinds != DATA
    members = fps[stored]
    left = np.searchsorted(keys[stored], keys[asking], "left")
    count = np.searchsorted(keys[stored], keys[asking], "right") - left
    ask = fps[asking]
    ends = np.cumsum(count)
    links_a, links_b = [], []
    at, total = 0, int(ends[-1]) if len(ends) else 0
    while at < total:
        stop = min(at + PAIRS, total)
        place = np.arange(at, stop)
        who = np.searchsorted(ends, place, "right")
        other = members[left[who] + place - (ends[who] - count[who])]
        mine = ask[who]
        near = (np.bitwise_count(mine ^ other) <= distance) & (mine != other)
        a, b = mine[near], other[near]
        if len(a):
            a, b = forest(a, b)
            links_a.append(a)
            links_b.append(b)
        at = stop
    if not links_a:
        return None
    return forest(np.concatenate(links_a), np.concatenate(links_b))


def links(fps: DataFrame, distance: int = DISTANCE, partitions: int = PARTITIONS) -> DataFrame:
    """(a, b) longs: a forest of the graph that joins fingerprints (distinct, column ``fp``) within ``distance`` bits."""
    both = np.zeros(64 * 64, dtype=np.int64)
    for cell, n in _counted(fps, _both_set).items():
        both[cell] = n
    n = fps.count()
    m = partitions
    groups = group_bits(both.reshape(64, 64), max(n, 1), m)
    units = distance + 1

    def histogram(values):
        return np.concatenate([np.bincount((project(values, g[:COARSE])).astype(np.int64), minlength=1 << COARSE) for g in groups])

    counts = np.zeros(m << COARSE, dtype=np.int64)
    for cell, k in _counted(fps, histogram).items():
        counts[cell] = k
    tables = [candidate_table(counts[i << COARSE:(i + 1) << COARSE], len(g), units) for i, g in enumerate(groups)]
    balls = [[0] + [ball(len(g), u - 1) for u in range(1, units + 1)] for g in groups]
    masks = [[_masks(len(g), u - 1) for u in range(units + 1)] if len(g) < 24 else [_masks(len(g), min(u - 1, 2)) for u in range(units + 1)] for g in groups]

    def costs_of(values):
        out = []
        for i, g in enumerate(groups):
            cell = project(values, g[:COARSE]).astype(np.int64)
            cost = np.array(balls[i], dtype=float)[:, None] + VERIFY_COST * tables[i][:, cell]
            for u in range(units + 1):
                if u and len(masks[i][u]) + 1 < balls[i][u]:
                    cost[u] = np.inf  # too wide a ball to list
            out.append(cost)
        return out

    def signatures(batches, stored_only=False):
        for batch in batches:
            values = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(values), 4096):
                part = values[at:at + 4096]
                given = allocate(costs_of(part), units)
                keys, fp, kind = [], [], []
                for i, g in enumerate(groups):
                    base = project(part, g)
                    keys.append(base | np.uint64(i << 56))
                    fp.append(part)
                    kind.append(np.where(given[:, i] > 0, OWN, DATA).astype(np.int8))
                    for u in range(2, 1 if stored_only else units + 1):
                        rows = np.flatnonzero(given[:, i] == u)
                        if len(rows):
                            flips = masks[i][u]
                            keys.append((base[rows][:, None] ^ flips[None, :]).ravel() | np.uint64(i << 56))
                            fp.append(np.repeat(part[rows], len(flips)))
                            kind.append(np.full(len(rows) * len(flips), PROBE, dtype=np.int8))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate(kind))],
                    ["key", "fp", "kind"])

    def stored(batches):
        return signatures(batches, stored_only=True)

    schema = "key long, fp long, kind byte"
    rows = _split_buckets(fps.select("fp").mapInArrow(signatures, schema), fps.select("fp").mapInArrow(stored, schema))

    def verify(batches):
        keys, fp, kinds = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int8)
        empty = True

        def found(k, f, c):
            out = _verify(k, f, c, distance)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[0].view(np.int64)), pa.array(out[1].view(np.int64))], ["a", "b"])

        for batch in batches:
            empty = empty and not batch.num_rows
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
            kinds = np.concatenate([kinds, batch.column(2).to_numpy()])
            if len(keys) < 1 << 18:
                continue
            whole = int(np.searchsorted(keys, keys[-1], "left"))  # the last bucket may go on in the next batch
            yield from found(keys[:whole], fp[:whole], kinds[:whole])
            keys, fp, kinds = keys[whole:], fp[whole:], kinds[whole:]
        if not empty:
            yield from found(keys, fp, kinds)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def _split_buckets(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Deals the members of a bucket over ``BUCKET`` rows over several; what probes it goes to each of them.

    The part is written into the key, between the value and the partition.
    """
    sizes = stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET)
    sizes = materialise(sizes, "buckets").select("key", F.ceil(F.col("n") / BUCKET).cast("int").alias("parts"))
    told = rows.join(sizes, "key", "left")
    whole = F.col("parts").isNull()
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    parts = F.when(whole, F.array(F.lit(0))).when(F.col("kind") == DATA, F.array(mine)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = told.withColumn("part", F.explode(parts))
    # a member that probes its own bucket is stored in one part and only probes the others
    kind = F.when(~whole & (F.col("kind") == OWN) & (F.col("part") != mine), F.lit(PROBE)).otherwise(F.col("kind")).cast("byte")
    return spread.select((F.col("key") + F.shiftleft(F.col("part").cast("long"), 32)).alias("key"), "fp", kind.alias("kind"))


def classes(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(*, root): distinct fingerprints with the one that names their component."""
    roots = components(links(fps, distance), "a", "b").withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def assign(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row."""
    marks = materialise(fingerprints(docs, words), "fingerprints")
    distinct = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct")
    rooted = classes(distinct, distance)
    sizes = materialise(rooted.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("members")), "classes")
    named = materialise(attach(rooted, sizes, "root", "members").select("fp", "component_id", "n"), "named")
    out = attach(marks, named, "fp", "n")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def survivors(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` without those whose id is another than their component's.

    Rows that share an id stay together, if any of them has its component's id; rows without an id stay.
    """
    found = assign(docs, words, distance).where("doc_id IS NOT NULL")
    gone = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays")).where("NOT stays")
    gone = materialise(gone.select(F.col("doc_id").alias("gone_id")), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")
