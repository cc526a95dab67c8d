"""Benchmark passages in documents, by Wu-Manber search over words.

A window is ``WINDOW`` consecutive words of a benchmark item, or all words of a
shorter one.  Windows of one length make a searcher:

* the shift table tells, for the hash of the last ``CHUNK`` words under the
  window's end, how far the end can move before any window could match; a word
  that no item has lets it move past that word;
* where it cannot move, windows whose last words have that hash form a bucket,
  ordered by the hash of their first words;
* those with the same first words are compared word by word.

Items are packed into blocks of up to ``BLOCK_BYTES`` of text (an item is never
cut).  A block is broadcast and all documents pass it; what further blocks find is
joined by the digest of the text.  Memory is that of one block, whatever the
number of items.  Long texts are searched in stretches that overlap by a window.

Defined cases: a null or empty text has no words and no hits; items without
words have no window and count nowhere; rows that share an item_id are one item;
items with a null item_id mark words but count as no item; rows that share a
doc_id, or have none, give a row each; without items nothing is hit; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pickle
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, loaded, materialise, ship_package

WINDOW, CHUNK = 10, 3
BLOCK_BYTES = 16 << 20     # of item text in one broadcast block
STRETCH_BYTES = 1 << 20    # of document text cut into words at a time
MIX = 0x9E3779B97F4A7C15
LOW = (1 << 64) - 1
# letters in lower case, digits and bytes from 0x80 stay; all else parts words
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(body: bytes) -> list[bytes]:
    return body.translate(WORD_BYTES).split()


def mixed(ids) -> int:
    h = 0
    for i in ids:
        h = ((h ^ i) * MIX & LOW) ^ (h >> 29)
    return h


def _mixed_columns(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        h = ((h ^ c.astype(np.uint64)) * np.uint64(MIX)) ^ (h >> np.uint64(29))
    return h


class Windows:
    """Searcher for the windows of one length: ``rows`` are their word numbers, ``owners`` the items of each."""

    def __init__(self, rows: np.ndarray, owners: np.ndarray):
        self.length = rows.shape[1]
        self.chunk = min(CHUNK, self.length)
        order = np.lexsort(rows.T)
        rows, owners = rows[order], owners[order]
        new = np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        rows = rows[first]
        pairs = np.unique(np.stack([group, owners], axis=1), axis=0)
        suffix = _mixed_columns([rows[:, self.length - 1 - j] for j in range(self.chunk)])  # last word first
        prefix = _mixed_columns([rows[:, j] for j in range(self.chunk)])
        self.bits = max(10, int(len(rows)).bit_length() + 4)
        cells = (suffix >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.lexsort((prefix, cells))
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        pairs[:, 0] = place[pairs[:, 0]]
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        self.rows, self.prefixes = rows[order].tolist() if len(rows) < 1 << 16 else rows[order], memoryview(np.ascontiguousarray(prefix[order]))
        self.starts = memoryview(np.searchsorted(cells[order], np.arange((1 << self.bits) + 1)))
        self.owner_starts, self.owners = np.searchsorted(pairs[:, 0], np.arange(len(order) + 1)), pairs[:, 1]
        far = self.length - self.chunk + 1
        shift = np.full(1 << self.bits, far, dtype=np.uint8)
        for end in range(self.chunk - 1, self.length):
            at = (_mixed_columns([rows[:, end - j] for j in range(self.chunk)]) >> np.uint64(64 - self.bits)).astype(np.int64)
            shift[at] = np.minimum(shift[at], self.length - 1 - end)
        self.shift = shift.tobytes()

    def search(self, words: list[bytes], number) -> list[tuple[int, int]]:
        """(start, window) of each occurrence; ``number`` gives a word's number, or None."""
        m, chunk, shift, drop = self.length, self.chunk, self.shift, 64 - self.bits
        out, end, n = [], m - 1, len(words)
        while end < n:
            h = 0
            for back in range(end, end - chunk, -1):
                i = number(words[back])
                if i is None:
                    end = back + m  # no window covers this word
                    break
                h = ((h ^ i) * MIX & LOW) ^ (h >> 29)
            else:
                cell = h >> drop
                step = shift[cell]
                if step:
                    end += step
                    continue
                start = end - m + 1
                ids = [number(w) for w in words[start:end + 1]]
                if None not in ids:
                    first = mixed(ids[:chunk])
                    last = self.starts[cell + 1]
                    at = bisect_left(self.prefixes, first, self.starts[cell], last)
                    while at < last and self.prefixes[at] == first:
                        if list(self.rows[at]) == ids:
                            out.append((start, at))
                            break
                        at += 1
                end += 1
        return out

    def items(self, window: int) -> np.ndarray:
        return self.owners[self.owner_starts[window]:self.owner_starts[window + 1]]


class Block:
    """Searchers for the items of one block, by length of window."""

    def __init__(self, content: bytes):
        names, texts = pickle.loads(content)
        self.names = names
        self.numbers: dict[bytes, int] = {}
        rows: dict[int, list[np.ndarray]] = {}
        owners: dict[int, list[np.ndarray]] = {}
        for item, text in enumerate(texts):
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words], dtype=np.uint32)
            length = min(WINDOW, len(words))
            found = np.lib.stride_tricks.sliding_window_view(ids, length)
            rows.setdefault(length, []).append(found)
            owners.setdefault(length, []).append(np.full(len(found), item))
        self.searchers = [Windows(np.concatenate(rows[k]), np.concatenate(owners[k])) for k in sorted(rows)]

    def hits(self, body: bytes) -> tuple[int, list[tuple[int, int]], list[str]]:
        """(number of words, disjoint word ranges that are hit, item names) of a text."""
        body = body.translate(WORD_BYTES)
        number = self.numbers.get
        total, at, tail = 0, 0, []
        ranges, seen = [], [set() for _ in self.searchers]
        while at < len(body):
            cut = body.find(b" ", at + STRETCH_BYTES)
            cut = len(body) if cut < 0 else cut
            fresh = body[at:cut].split()
            words = tail + fresh
            base = total - len(tail)
            for k, searcher in enumerate(self.searchers):
                for start, window in searcher.search(words, number):
                    ranges.append((base + start, base + start + searcher.length))
                    seen[k].add(window)
            total += len(fresh)
            tail, at = words[-(WINDOW - 1):], cut
        items = {self.names[i] for k, s in enumerate(self.searchers) for w in seen[k] for i in s.items(w)}
        return total, joined(ranges), sorted(i for i in items if i is not None)


def joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> DataFrame:
    """(content binary): blocks of items, each of up to ``limit`` bytes of text or of one item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    size = items.agg(F.sum(F.length("body") + 64)).first()[0] or 0

    def run(batches):
        names, texts, held = [], [], 0
        for batch in batches:
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if texts and held + len(body) + 64 > limit:
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((names, texts))], pa.binary())], ["content"])
                    names, texts, held = [], [], 0
                names.append(item)
                texts.append(body)
                held += len(body) + 64
        if texts:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((names, texts))], pa.binary())], ["content"])

    return items.repartition(max(1, -(-size // limit))).mapInArrow(run, "content binary")


SPAN = "array<struct<start: long, stop: long>>"


def _pass(docs: DataFrame, content: bytes, every_row: bool) -> DataFrame:
    """(doc_id, n_words, digest, ranges, items) of all rows, or of those that this block hits."""
    held = docs.sparkSession.sparkContext.broadcast(content)
    id_type = dict(docs.dtypes)["doc_id"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        block = loaded(Block, held.value)
        for batch in batches:
            rows = []
            for at, body in enumerate(batch.column(1)):
                body = body.as_py()
                n, ranges, items = block.hits(body)
                if every_row or ranges:
                    rows.append((at, n, hashlib.sha256(body).digest(), [{"start": a, "stop": b} for a, b in ranges], items))
            if rows:
                at, n, digest, ranges, items = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(ranges, spans), pa.array(items, pa.list_(pa.string()))],
                    ["doc_id", "n_words", "digest", "ranges", "items"])

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    return docs.select("doc_id", body).mapInArrow(run, f"doc_id {id_type}, n_words long, digest binary, ranges {SPAN}, items array<string>")


def spans(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, ranges, items) per row: the word ranges [start, stop) that any window covers, in order, and the items found."""
    ship_package(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    packed = materialise(blocks(benchmark.select("item_id", "text"), block_bytes), "items")
    found, more = None, None
    for row in packed.toLocalIterator():  # one block at a time
        if found is None:
            found = _pass(docs, bytes(row.content), True)
            continue
        part = _pass(docs, bytes(row.content), False).select("digest", F.struct("ranges", "items").alias("part")).dropDuplicates(["digest"])
        part = materialise(part, "hits")
        more = part if more is None else more.unionByName(part)
    if found is None:
        found = _pass(docs, pickle.dumps(([], [])), True)
    if more is None:
        return found.select("doc_id", "n_words", "ranges", "items")
    found = materialise(found, "first")
    copies = found.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"))
    parts = more.groupBy("digest").agg(F.collect_list("part").alias("parts")).join(copies, "digest")
    told = attach(found, materialise(parts, "parts"), "digest", "copies")
    none = F.coalesce(F.col("parts"), F.array())
    told = told.select("doc_id", "n_words", F.concat("ranges", F.flatten(F.transform(none, lambda p: p.ranges))).alias("ranges"),
                       F.array_distinct(F.concat("items", F.flatten(F.transform(none, lambda p: p["items"])))).alias("items"))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            ranges = [[{"start": a, "stop": b} for a, b in joined([(r["start"], r["stop"]) for r in row])] for row in batch.column(2).to_pylist()]
            yield batch.set_column(2, "ranges", pa.array(ranges, kinds))

    return told.mapInArrow(run, told.schema)


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    found = spans(docs, benchmark, block_bytes)
    hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, r: total + r.stop - r.start)
    found = found.withColumn("n_hit", hit)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
