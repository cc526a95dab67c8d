"""Quality score from compression with dictionaries of good and of bad text.

Two zstandard dictionaries are built from labelled texts.  A text is cut into
blocks, the whole text, nothing left out; every block is compressed with either
dictionary, and the difference of the summed sizes, over their sum, says which
kind of text it looks like.  A logistic fit on labelled texts that were not used
for the dictionaries turns the difference, with the ratio of compression and the
shortness of the text beside it, into a probability.

The model is fitted on a bounded sample: at most ``per_class`` labelled rows
of each class, those with the lowest hash of their id, and of these at most
``class_bytes`` of text: one that no longer fits is passed over for later ones that do.  A
dictionary is trained on at most ``100 * DICTIONARY`` bytes of blocks, dealt evenly over
the sample's texts; calibration takes whole texts.  Scoring streams over the table; a task holds one
batch and two dictionaries of ``DICTIONARY`` bytes.

Defined cases: a null text counts as empty; an empty text gets the score of a
difference of zero, a ratio of one and full shortness; null labels, labels without a document and documents
without a label are not learned from; with labels of one class only (or none),
every score is the smoothed share of label 1 (or 0.5); repeated rows give a row each; a null
id is scored and never learned from; a text of any length is scored whole, block by block; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, ship_package

PER_CLASS, CLASS_BYTES = 3000, 16 << 20
DICTIONARY, BLOCK, LEVEL = 64 << 10, 1 << 10, 3
PARTS, HELD_PART = 3, 1  # rows whose hash mod 3 is 1 are held out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, class_bytes: int = CLASS_BYTES):
    """Up to ``per_class`` (text, label) of each class from rows that are not held out; texts as bytes, in the order of a hash."""
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"), PARTS, HELD_PART))
    known = known.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    order = [F.xxhash64("_id"), F.col("_id")]
    few = [known.where(F.col("_label") == v).distinct().orderBy(*order).limit(per_class) for v in (0, 1)]
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    few = few[0].unionByName(few[1])  # at most 2 * per_class rows, so it may be broadcast
    rows = docs.select("doc_id", body).join(F.broadcast(few), F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy("_id", "_label").agg(F.max("body").alias("body"))  # a repeated id counts once
    rows = materialise(rows.select("_id", "_label", F.xxhash64("_id").alias("at"), "body", F.octet_length("body").alias("n")), "sample")
    total, ids = {0: 0, 1: 0}, []
    for r in sorted(rows.select("at", "_id", "_label", "n").collect()):  # sizes first: no text leaves the executors yet
        if total[r._label] + r.n <= class_bytes:
            total[r._label] += r.n
            ids.append(r._id)
    texts = rows.where(F.col("_id").isin(ids)).select("at", "_id", "_label", "body").collect()
    return [(bytes(r.body), r._label) for r in sorted(texts, key=lambda r: (r.at, r._id, r._label))]


def blocks(body: bytes) -> list[bytes]:
    return [body[i:i + BLOCK] for i in range(0, len(body), BLOCK)]


def features(good: int, bad: int, raw: int) -> list[float]:
    """Normalised difference (positive: the dictionary of good text compresses better), ratio, shortness, and the
    difference again as far as the text is short, where it says less."""
    x = (bad - good) / (bad + good) if bad + good else 0.0
    ratio = min((bad + good) / 2 / raw, 1.0) if raw else 1.0
    short = 1 / (1 + raw / 64)
    return [x, ratio, short, x * short]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]  # of the features, and the constant

    def measure(self):
        packers = []
        for d in (self.good, self.bad):
            learned = zstandard.ZstdCompressionDict(d)
            learned.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=learned, write_content_size=False, write_dict_id=False, write_checksum=False).compress)
        good, bad = packers

        def of(body):
            parts = blocks(body)
            return features(sum(map(len, map(good, parts))), sum(map(len, map(bad, parts))), len(body))

        return of

    def scorer(self):
        if not self.good:
            return lambda body: float(1 / (1 + np.exp(-self.weights[-1])))
        of, (*w, constant) = self.measure(), self.weights
        return lambda body: float(1 / (1 + np.exp(-np.clip(sum(a * b for a, b in zip(w, of(body))) + constant, -30, 30))))


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of blocks dealt evenly over the texts, so that a few long ones do not fill it."""
    parts, total = [], 0
    rounds = [blocks(t) for t in texts if t]
    at = 0
    while total < 100 * DICTIONARY and any(len(r) > at for r in rounds):
        for r in rounds:
            if len(r) > at:
                # a far block of each text in turn, from a place fixed by its content
                part = r[(zlib.crc32(r[0]) + at) % len(r)]
                parts.append(part)
                total += len(part)
        at += 1
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their plain content serves as a dictionary
        return b"".join(parts)[-DICTIONARY:] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2) -> list[float]:
    """Slopes and constant of a weighted fit by Newton steps; columns are scaled to unit spread meanwhile."""
    spread = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    middle = x.mean(axis=0)
    design = np.column_stack([(x - middle) / spread, np.ones(len(x))])
    ridge = np.diag([penalty] * x.shape[1] + [0.0])
    w = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        slope = design.T @ (weight * (y - p)) - ridge @ w
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return [*slopes.tolist(), float(w[-1] - slopes @ middle)]


def fit(sample: list[tuple[bytes, int]], shares: tuple[int, int]) -> Model:
    """Dictionaries from the first half of each class, calibration on the other, where a class weighs what its labels do."""
    by = {v: [t for t, y in sample if y == v] for v in (0, 1)}
    if min(len(by[0]), len(by[1])) < 2:
        n0, n1 = shares
        share = (n1 + 0.5) / (n0 + n1 + 1)
        return Model(b"", b"", [float(np.log(share / (1 - share)))])
    halves = {v: (ts[: len(ts) // 2], ts[len(ts) // 2:]) for v, ts in by.items()}
    model = Model(dictionary(halves[1][0]), dictionary(halves[0][0]), [])
    of = model.measure()
    x = np.array([of(t) for v in (0, 1) for t in halves[v][1]])
    y = np.array([float(v) for v in (0, 1) for _ in halves[v][1]])
    weight = np.where(y == 1, shares[1] / len(halves[1][1]), shares[0] / len(halves[0][1])) * len(y) / sum(shares)
    model.weights = logistic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            s = pa.array([of(b) for b in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], ["doc_id", "score"])

    body = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body")
    out = docs.select("doc_id", body).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_PART).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def label_counts(labels: DataFrame, label: str) -> tuple[int, int]:
    """Labels 0 and 1 of rows that are not held out."""
    known = labels.where(~held_out(F.col("doc_id"), PARTS, HELD_PART))
    row = known.agg(F.count_if(F.col(label) == 0).alias("zero"), F.count_if(F.col(label) == 1).alias("one")).first()
    return row.zero, row.one


def accepted(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with all their columns."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled_sample(docs, labels, label), label_counts(labels, label)))
    at = docs.columns.index("text")

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of((t or "").encode()) >= least for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels, label), label_counts(labels, label)))
