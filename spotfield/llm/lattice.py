"""Probability of a text summed over all its segmentations into subwords.

A text is its words and an end.  Each word, with a mark in front, is spelled by
pieces of an existing vocabulary, by single bytes where it has none, or, if the
word occurs in training, by itself as one piece.  The marginal probability of a
word sums over all these segmentations: a forward recursion in log space over
its lattice, where pieces that hold the mark begin a word and the others go on
with it.  No piece holds a mark past its first character, so the lattice of a
text falls apart into those of its words.

Whole words keep their count less a discount (from the numbers of words seen
once and twice); what is taken from them weighs the subword lattice, which is
therefore fitted on distinct words.  All probabilities sum to one.

* Counting: tasks count the words of the training documents and sums of the
  counts are written as a table, one row a word, which grows with the corpus.
* Weights: all pieces start equal; each round of expectation maximisation goes
  over the whole table of words, and only sums per piece, of fixed number,
  reach the driver.  Two rounds follow one another, a scan of the table each.
* Scoring: the most frequent words, ``FREQUENT`` at most, go to every task; any other
  word of a document is looked up by a join, so a word is known if and only if
  it occurs in training, however rare.  A word's lattice is summed once where
  the rows of that word meet.

Defined cases: a null text counts as empty and consists of the end only; rows
with a null id are scored too (their id counts as the empty text when training
rows are chosen); repeated rows count and are scored as often as they occur;
with nothing to train on, all pieces are equally likely, no word is known, and
a text goes on or ends with equal chance;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import exp, inf, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from .common import held_out, materialise, ship_package

MARK = "▁"
PARTS, HELD_PART = 7, 2
FREQUENT, ROUNDS, FLOOR = 200_000, 2, 0.01
SHORT = 40  # characters of a marked word up to which expectations are taken without logarithms
FLUSH = 400_000  # distinct words a task counts before it hands them on
LN10 = log(10.0)


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A to Z in lower case."""
    return text.encode().lower().split()


def vocabulary(model: bytes) -> list[str]:
    """Pieces usable inside one marked word; the numbers of the single bytes follow theirs."""
    spec = proto.ModelProto()
    spec.ParseFromString(model)
    return [p.piece for p in spec.pieces if p.type == 1 and MARK not in p.piece[1:]]


class Lattice:
    def __init__(self, pieces: list[str], weights: np.ndarray):
        """``weights``: log probabilities of the pieces and the 256 bytes."""
        self.bytes_at = len(pieces)
        self.byte_weights = weights[len(pieces):].tolist()
        self.single: dict[str, tuple[float, float]] = {}
        self.trie: dict = {}
        for i, (piece, w) in enumerate(zip(pieces, weights.tolist())):
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i, w, exp(w)

    def _spelled(self, c: str) -> tuple[float, float]:
        w = sum([self.byte_weights[b] for b in c.encode()])
        if len(self.single) < 1 << 16:
            self.single[c] = w, exp(w)
        return w, exp(w)

    def edges(self, text: str, plain: bool = False) -> list[list[tuple[int, int, float]]]:
        """Of each place: (place after, piece, log or plain weight) of every piece that starts there; -1 is a character's bytes."""
        out, n, trie, single, kind = [], len(text), self.trie, self.single, 2 if plain else 1
        for i in range(n):
            c = text[i]
            here = [(i + 1, -1, (single.get(c) or self._spelled(c))[kind - 1])]
            node, j = trie.get(c), i + 1
            while node is not None:
                found = node.get("")
                if found is not None:
                    here.append((j, found[0], found[kind]))
                if j == n:
                    break
                node = node.get(text[j])
                j += 1
            out.append(here)
        return out

    @staticmethod
    def forward(edges) -> list[float]:
        """Logarithm of the sum over all ways to each place."""
        into: list[list[float]] = [[] for _ in range(len(edges) + 1)]
        into[0].append(0.0)
        total = []
        for ways, here in zip(into, [*edges, ()]):
            if len(ways) == 1:
                a = ways[0]
            else:
                top = max(ways)
                a = top + log(sum([exp(w - top) for w in ways]))
            total.append(a)
            for j, _, w in here:
                into[j].append(a + w)
        return total

    def log_probability(self, word: str) -> float:
        """Natural logarithm of the sum over all segmentations of the marked word."""
        return self.forward(self.edges(MARK + word))[-1]

    def expect(self, word: str, counts: list[float]) -> None:
        """Adds the expected number of each piece over all segmentations."""
        text = MARK + word
        if len(text) <= SHORT:  # plain products of so few weights do not vanish
            edges = self.edges(text, True)
            n = len(edges)
            before, after = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            for i in range(n):
                a = before[i]
                for j, _, w in edges[i]:
                    before[j] += a * w
            for i in range(n - 1, -1, -1):
                after[i] = sum([w * after[j] for j, _, w in edges[i]])
            whole = 1 / before[n]
            for i in range(n):
                a = before[i] * whole
                for j, piece, w in edges[i]:
                    if piece >= 0:
                        counts[piece] += a * w * after[j]
                    else:
                        self._count_bytes(text[i], a * w * after[j], counts)
            return
        edges = self.edges(text)
        before = self.forward(edges)
        n = len(edges)
        after = [-inf] * n + [0.0]
        for i in range(n - 1, -1, -1):
            parts = [w + after[j] for j, _, w in edges[i]]
            top = max(parts)
            after[i] = top + log(sum([exp(p - top) for p in parts]))
        for i, here in enumerate(edges):
            a = before[i] - before[n]
            for j, piece, w in here:
                share = exp(a + w + after[j])
                if piece >= 0:
                    counts[piece] += share
                else:
                    self._count_bytes(text[i], share, counts)

    def _count_bytes(self, c: str, share: float, counts: list[float]) -> None:
        for b in c.encode():
            counts[self.bytes_at + b] += share


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) of the words of training documents, as a written table."""

    def run(batches):
        counts: Counter = Counter()

        def emit():
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield from emit()
        yield from emit()

    ship_package(docs.sparkSession)
    train = docs.where(~held_out(F.col("doc_id"), PARTS, HELD_PART)).select(F.coalesce(F.col("text"), F.lit("")).alias("body"))
    return materialise(train.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "words")


def learn(words: DataFrame, pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces and bytes after ``rounds`` of expectation maximisation over distinct words."""
    size = len(pieces) + 256
    weights = np.full(size, -np.log(size))
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, weights))  # of the vocabulary's size

        def run(batches, shared=shared):
            lattice = Lattice(*shared.value)
            counts = [0.0] * size
            for batch in batches:
                for word in batch.column(0).to_pylist():
                    lattice.expect(word.decode(), counts)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.array(counts)[some])], ["piece", "n"])

        counts = np.full(size, FLOOR)
        for r in words.select("word").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[r.piece] += r.n
        weights = np.log(counts / counts.sum())
    return weights


def score(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row."""
    spark = docs.sparkSession
    pieces = vocabulary(model)
    words = count_words(docs)
    c = F.col("c")
    totals = words.agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"), F.count_if(c == 1).alias("once"), F.count_if(c == 2).alias("twice")).first()
    ends = docs.where(~held_out(F.col("doc_id"), PARTS, HELD_PART)).count()
    train_tokens = (totals.n or 0) + ends
    room = log(train_tokens + totals.v + (1 if ends else 0) + 1)
    discount = (totals.once + 1) / (totals.once + 2 * totals.twice + 2)
    all_mass = log(train_tokens + 2)  # one more end and one more unknown word than were seen
    spelled = log(discount * totals.v + 1) - all_mass
    weights = learn(words, pieces)
    shared = spark.sparkContext.broadcast((pieces, weights))  # of the vocabulary's size

    def weigh(batches):
        """Adds the log probability to rows with a word in the first column; rows of one word come together."""
        lattice = Lattice(*shared.value)
        last, value = None, 0.0
        for batch in batches:
            out = []
            for word in batch.column(0).to_pylist():
                if word != last:
                    last, value = word, lattice.log_probability(word.decode())
                out.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], [*batch.schema.names, "w"])

    # the words above a count, which is chosen on a histogram of fixed size so that they are FREQUENT at most
    step = F.floor(F.log2(c) * 8)
    room_left, least = FREQUENT, None
    for r in sorted(words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        room_left -= r.n
        if room_left < 0:
            break
        least = r.step
    frequent = words.where(step >= least) if least is not None else words.limit(0)
    top = {bytes(r.word): (log(r.c + 1) - room, log((r.c - discount) / exp(all_mass) + exp(r.w + spelled))) for r in frequent.mapInArrow(weigh, "word binary, c long, w double").collect()}
    known = spark.sparkContext.broadcast(top)  # FREQUENT words at most
    end_base = log(ends + 1) - room
    end_known, end_weight = int(ends > 0), log(ends + 1) - all_mass

    def scan(batches):
        """Sums over the end and the frequent words of each text, and its other words with their numbers."""
        table = known.value
        for batch in batches:
            tokens, found, base, total, names, numbers = [], [], [], [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                n_known, b, w, rare, often = end_known, end_base, end_weight, [], []
                for word, n in Counter(words).items():
                    entry = table.get(word)
                    if entry is None:
                        rare.append(word)
                        often.append(n)
                    else:
                        n_known += n
                        b += n * entry[0]
                        w += n * entry[1]
                tokens.append(len(words) + 1)
                found.append(n_known)
                base.append(b)
                total.append(w)
                names.append(rare)
                numbers.append(often)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(found, pa.int64()), pa.array(base, pa.float64()),
                 pa.array(total, pa.float64()), pa.array(names, pa.list_(pa.binary())), pa.array(numbers, pa.list_(pa.int64()))],
                ["row", "doc_id", "n_tokens", "n_known", "base", "total", "names", "numbers"])

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body")).mapInArrow(
        scan, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, total double, names array<binary>, numbers array<long>")
    rows = materialise(rows, "scanned")  # row numbers are fixed by what is written
    rare = rows.select("row", F.explode(F.arrays_zip("names", "numbers")).alias("e")).select(F.col("e.names").alias("word"), F.col("e.numbers").alias("n"), "row")
    # rows of one word meet, in order, so that its lattice is summed once
    met = rare.join(words, "word", "left").select("word", "n", "row", "c").repartition("word").sortWithinPartitions("word")
    weighed = met.mapInArrow(weigh, "word binary, n long, row long, c long, w double")
    n = F.col("n")
    sums = weighed.groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), n).otherwise(0)).alias("k"), F.sum(n * (F.log(F.coalesce("c", F.lit(0)) + 1.0) - room)).alias("b"),
        F.sum(n * F.when(c.isNull(), F.col("w") + spelled).otherwise(F.log((c - discount) / exp(all_mass) + F.exp(F.col("w") + spelled)))).alias("s"))
    none = F.lit(0)
    return rows.drop("names", "numbers").join(sums, "row", "left").select(
        "doc_id", held_out(F.col("doc_id"), PARTS, HELD_PART).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("k", none)).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"), ((F.col("base") + F.coalesce("b", none)) / LN10).alias("base_score"),
        ((F.col("total") + F.coalesce("s", none)) / LN10).alias("score"))
