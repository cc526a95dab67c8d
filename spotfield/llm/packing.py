"""Packing of tokenized documents into fixed sequences by cutting-stock column generation.

1. Tasks tokenize texts and keep lengths and checksums.  A document of more
   than ``capacity`` tokens is cut into full pieces and a remainder.
2. The remainders' lengths, as a histogram over a fixed set of size classes,
   go to the driver.  A linear program over patterns (how many pieces of each
   class share a sequence) is solved by column generation: a knapsack dynamic
   program over the dual prices proposes the next pattern, until the bound it
   implies is within ``GAP`` of the optimum.
3. Patterns are rounded down; the few pieces left, bounded by the number of
   classes and not by the input, are packed first-fit decreasing.
4. Pieces are ranked inside their class, and a rank says which copy of which
   pattern holds the piece, so the assignment is a lookup in a table of fixed size.

If whole remainders would leave more than ``WASTE`` of padding, they are cut at
a half, a quarter or an eighth of the capacity, the coarsest that does.

Defined cases: a null text counts as empty and has the end token only; repeated
rows are packed as often as they occur; null ids are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, loaded, materialise, ship_package

CAPACITY, END = 2048, 1
REMEMBERED = 200_000
GAP, WASTE, CALM = 2e-3, 0.02, 0.9
RANKED = 200_000  # pieces of a class ranked by one task
# a space between two characters that are no white space always starts a new word
BOUNDARY = re.compile(r" (?<=\S )(?=\S)")
# fixed value: the word pattern of the byte-level vocabulary
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_symbol() -> dict[str, int]:
    """The bytes that a byte-level vocabulary writes as printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of texts under a byte-level BPE vocabulary file, as packed 32-bit little-endian integers."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        table = byte_of_symbol()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(table[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ")) if isinstance(m, str) else "".join(m)] for m in spec["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("ids do not follow the order of merges")
        self.coder = tiktoken.Encoding("byte_level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.known = Remembered(lambda word: self._encode(" " + word), REMEMBERED)

    def _encode(self, text: str) -> bytes:
        ids = array("I", self.coder.encode(text, allowed_special=self.special, disallowed_special=()))
        return ids.tobytes()

    def ids(self, text: str) -> bytes:
        first, *words = BOUNDARY.split(text)
        return self._encode(first) + b"".join(map(self.known.__getitem__, words))


def cut_sizes(capacity: int) -> list[int]:
    return [capacity >> k for k in range(4)]


def measured(docs: DataFrame, vocabulary: bytes, capacity: int, end: int) -> DataFrame:
    """(doc_id, doc_tokens, full, rest): checksums of the full pieces, and of the remainder under each cut size."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a file of fixed size
    last = array("I", [end]).tobytes()

    def checks(ids, start, step):
        return [crc32(ids[i:i + 4 * step]) for i in range(start, len(ids), 4 * step)]

    def run(batches):
        tokens = loaded(Tokens, shared.value)
        for batch in batches:
            n, full, rest = [], [], []
            for text in batch.column(1).to_pylist():
                ids = tokens.ids(text) + last
                count = len(ids) // 4
                whole = count // capacity * capacity
                n.append(count)
                full.append(checks(ids[: 4 * whole], 0, capacity))
                rest.append([checks(ids, 4 * whole, step) for step in cut_sizes(capacity)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(full, pa.list_(pa.int64())), pa.array(rest, pa.list_(pa.list_(pa.int64())))],
                ["doc_id", "doc_tokens", "full", "rest"])

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, doc_tokens long, full array<long>, rest array<array<long>>"
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body")).mapInArrow(run, schema)


def classes(capacity: int) -> np.ndarray:
    """Sizes that lengths are rounded up to: exact up to 32, then 32 to an octave."""
    out, size = list(range(1, 33)), 32
    while size < capacity:
        out += [s for s in range(size + size // 32, 2 * size + 1, size // 32) if s <= capacity]
        size *= 2
    return np.array(sorted({*out, capacity}))


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most worth of any multiset of items that fits, and how often each item is in it.  ``sizes`` ascend.

    An item may be taken any number of times: along places of one remainder by
    its size, that is a running maximum.
    """
    rising = np.flatnonzero(worth > np.concatenate([[0.0], np.maximum.accumulate(worth)[:-1]]))  # others lose to a smaller item
    best, stages = np.zeros(capacity + 1), []
    for i in rising:
        s, y = sizes[i], worth[i]
        rows = -(-(capacity + 1) // s)
        grid = np.full(rows * s, -np.inf)
        grid[: capacity + 1] = best
        price = (np.arange(rows) * y)[:, None]
        stages.append(best)
        best = (np.maximum.accumulate(grid.reshape(rows, s) - price, axis=0) + price).ravel()[: capacity + 1]
    pattern, c, value = np.zeros(len(sizes), dtype=np.int64), capacity, float(best[capacity])
    for i, before in zip(reversed(rising), reversed(stages)):
        s, y = sizes[i], worth[i]
        k = np.arange(c // s + 1)
        take = int((before[c - k * s] + k * y).argmax())
        pattern[i] = take
        c -= take * s
    return value, pattern


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often to use each, fractional, to meet ``demand`` exactly with almost the fewest sequences.

    New patterns are priced near the prices with the best bound so far, which
    swing less than those of the current basis.
    """
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1 / np.diag(patterns))
    used = inverse @ demand
    bound, centre = 0.0, None
    while True:
        prices = inverse.sum(axis=0)  # of the current basis
        total = used.sum()
        for trial in ([prices] if centre is None else [CALM * centre + (1 - CALM) * prices, prices]):
            trial = np.maximum(trial, 0)
            value, new = knapsack(sizes, trial, capacity)
            if trial @ demand / value > bound:
                bound, centre = trial @ demand / value, trial / value
            if new @ prices > 1 + 1e-9:
                break
        if total - bound <= GAP * total or new @ prices <= 1 + 1e-9:
            return patterns, used
        way = inverse @ new
        steps = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        used = np.maximum(used - step * way, 0)
        used[out] = step
        pivot = inverse[out] / way[out]
        inverse -= np.outer(way, pivot)
        inverse[out] = pivot
        patterns[out] = new


def first_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[np.ndarray]:
    """Patterns that hold the few pieces left, largest first."""
    bins, room = [], []
    for i in reversed(range(len(sizes))):
        for _ in range(int(left[i])):
            at = next((k for k, r in enumerate(room) if r >= sizes[i]), None)
            if at is None:
                bins.append(np.zeros(len(sizes), dtype=np.int64))
                room.append(capacity)
                at = len(bins) - 1
            bins[at][i] += 1
            room[at] -= sizes[i]
    return bins


def plan(counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(pieces of each class, copies) of the patterns that hold exactly ``counts`` pieces of each class."""
    sizes = classes(capacity)
    some = np.flatnonzero(counts)
    if not len(some):
        return []
    patterns, used = solve(sizes[some], counts[some].astype(float), capacity)
    copies = np.floor(used + 1e-6).astype(np.int64)
    patterns = patterns.astype(np.int64)
    while (over := (copies @ patterns > counts[some])).any():  # a rounding error of the solution
        copies[np.flatnonzero((patterns[:, over].sum(axis=1) > 0) & (copies > 0))[0]] -= 1
    left = counts[some] - copies @ patterns
    out = [(p, int(c)) for p, c in zip(patterns, copies) if c] + [(p, 1) for p in first_fit(sizes[some], left, capacity)]
    return [(np.bincount(some, p, minlength=len(sizes)).astype(np.int64), c) for p, c in out]


def padding(planned, total: int, capacity: int) -> float:
    sequences = sum(c for _, c in planned)
    return 1 - total / (sequences * capacity) if sequences else 0.0


def lookup(planned) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of each class: first ranks, pieces to a copy, and first sequences of the patterns that hold it."""
    n = len(planned[0][0]) if planned else 0
    firsts, per, base = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
    done, sequence = np.zeros(n, dtype=np.int64), 0
    for pattern, copies in planned:
        for i in np.flatnonzero(pattern):
            firsts[i].append(int(done[i]))
            per[i].append(int(pattern[i]))
            base[i].append(sequence)
            done[i] += pattern[i] * copies
        sequence += copies
    as_arrays = lambda lists: [np.array(x, dtype=np.int64) for x in lists]
    return as_arrays(firsts), as_arrays(per), as_arrays(base)


def pack(docs: DataFrame, vocabulary: bytes, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) per piece."""
    known = materialise(measured(docs, vocabulary, capacity, end), "measured")
    sizes = classes(capacity)
    rest = (F.col("doc_tokens") % capacity).alias("rest")
    lengths = {r.rest: r.n for r in known.groupBy(rest).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    whole = known.agg(F.sum(F.floor(F.col("doc_tokens") / capacity))).first()[0] or 0
    options = []
    for k, cut in enumerate(cut_sizes(capacity)):
        counts = np.zeros(len(sizes), dtype=np.int64)
        for length, n in lengths.items():
            counts[np.searchsorted(sizes, cut)] += n * (length // cut)
            if length % cut:
                counts[np.searchsorted(sizes, length % cut)] += n
        planned = plan(counts, capacity)
        options.append((padding(planned, sum(a * n for a, n in lengths.items()), capacity), k, cut, planned))
        if options[-1][0] <= WASTE:
            break
    _, option, cut, planned = min(options, key=lambda o: o[0]) if options[-1][0] > WASTE else options[-1]
    planned = [(np.bincount([len(sizes) - 1], minlength=len(sizes)), int(whole)), *planned]

    at = F.floor(F.col("doc_tokens") / capacity) * capacity
    full = F.transform("full", lambda c, i: F.struct((i.cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("length"), c.alias("ids_crc32")))
    parts = F.transform(F.col("rest")[option], lambda c, i: F.struct(
        (at + i.cast("long") * cut).alias("start"),
        F.least(F.lit(cut).cast("long"), F.col("doc_tokens") - at - i.cast("long") * cut).alias("length"), c.alias("ids_crc32")))
    pieces = known.select("doc_id", "doc_tokens", F.explode(F.concat(full, parts)).alias("p")).select("doc_id", "doc_tokens", "p.*")
    # class of a length: one of a fixed list
    klass = F.element_at(F.array(*[F.lit(int(k)) for k in np.searchsorted(sizes, np.arange(1, capacity + 1))]), F.col("length").cast("int"))
    pieces = pieces.withColumn("class", klass)
    salts = max(16, -(-(int(whole) + sum(lengths.values())) // RANKED))
    # a rank is a place inside a salt of the class after all lower salts
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    sums = materialise(pieces.groupBy("class", "salt").agg(F.count(F.lit(1)).alias("n")), "ranks")
    before = F.sum("n").over(Window.partitionBy("class").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("class").alias("c"), F.col("salt").alias("s"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "start"))
    ranked = pieces.withColumn("inside", inside).join(sums, (F.col("class") == F.col("c")) & (F.col("salt") == F.col("s")))
    ranked = ranked.withColumn("rank", F.col("before") + F.col("inside") - 1)

    tables = docs.sparkSession.sparkContext.broadcast(lookup(planned))  # as many entries as the patterns have

    def assign(batches):
        firsts, per, base = tables.value
        for batch in batches:
            k, r = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            sequence = np.zeros(len(k), dtype=np.int64)
            for c in np.unique(k):
                mine = k == c
                which = np.searchsorted(firsts[c], r[mine], "right") - 1
                sequence[mine] = base[c][which] + (r[mine] - firsts[c][which]) // per[c][which]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sequence)], [*batch.schema.names[2:], "sequence_id"])

    kept = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = ", ".join(f"{c} {dict(ranked.dtypes)[c]}" for c in kept) + ", sequence_id long"
    placed = ranked.select("class", "rank", *kept).mapInArrow(assign, schema)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return placed.withColumn("offset", F.coalesce(offset, F.lit(0)))
