"""Toxicity from subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams and itself, each hashed to a row of
one embedding table; a misspelling that was never seen shares most rows with
the word it comes from.  The rows of a window of words are averaged and a
linear softmax over two classes gives its probability; a text is as toxic as its
worst window, so a few words in a long text are not averaged away.  Windows
overlap by half and cover the whole text.

Embeddings and softmax are trained together in numpy, by the loss of each
labelled text through its worst window, on a bounded sample: at most
``PER_CLASS`` rows of each class with the lowest hash of their id, and of
these at most ``CLASS_BYTES`` of text (``quality.labelled_sample``).  The
number of steps is chosen on a fifth of the sample that is set aside.

Scoring needs one number per row of the table, of fixed size; a task keeps
the scores of words it has met, up to ``REMEMBERED`` of them.

Defined cases: a null text counts as empty; a text without words gets the
score of an all-zero average; labels other than 0 and 1 and labels without a
document are not learned from; with labels of one class only (or none) every
score is the smoothed share of label 1 (or 0.5); repeated rows give a row each; a null
id is scored and never learned from; a text of any length is scored whole; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ship_package
from .quality import HELD_PART, PARTS, label_counts, labelled_sample

PER_CLASS, CLASS_BYTES = 3000, 6 << 20
BUCKETS, WIDTH, GRAMS = 1 << 16, 8, (3, 4, 5)
WINDOW = 6
STEPS, PATIENCE, RATE, DECAY = 160, 40, 0.05, 2e-6
REMEMBERED = 300_000
THRESHOLD = 0.7
WORD = re.compile(r"[^\W_]+")


def rows_of(word: str) -> list[int]:
    """Table rows of a word: itself and its n-grams, with marks at both ends."""
    marked = f"<{word}>"
    grams = [marked]
    for n in GRAMS:
        grams += [marked[i:i + n] for i in range(len(marked) - n + 1)]
    return [crc32(g) % BUCKETS for g in map(str.encode, grams)]


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def windows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the windows over n words."""
    step = WINDOW // 2
    starts = np.arange(0, max(n - step, 1), step)
    return starts, np.minimum(starts + WINDOW, n)


def worst(scores: np.ndarray) -> tuple[float, int, int]:
    """Highest mean of a window of word scores, with its bounds."""
    if not len(scores):
        return 0.0, 0, 0
    total = np.concatenate([[0.0], np.cumsum(scores)])
    starts, ends = windows(len(scores))
    means = (total[ends] - total[starts]) / (ends - starts)
    k = int(means.argmax())
    return float(means[k]), int(starts[k]), int(ends[k])


@dataclass
class Model:
    embeddings: np.ndarray  # (BUCKETS, WIDTH), or empty
    classes: np.ndarray     # (2, WIDTH) rows of the softmax
    constant: np.ndarray    # (2,)

    def row_scores(self) -> np.ndarray:
        """Of each row of the table: its part in the difference of the two classes' logits."""
        return self.embeddings @ (self.classes[1] - self.classes[0])

    def scorer(self):
        shift = float(self.constant[1] - self.constant[0])
        if not len(self.embeddings):
            return lambda text: 1 / (1 + np.exp(-shift))
        rows = self.row_scores().tolist()

        class Known(dict):
            def __missing__(self, word):
                if len(self) >= REMEMBERED:
                    self.clear()
                at = rows_of(word)
                self[word] = value = sum(map(rows.__getitem__, at)) / len(at)
                return value

        known = Known()

        def score(text):
            words = words_of(text)
            s = np.fromiter(map(known.__getitem__, words), dtype=np.float64, count=len(words))
            return float(1 / (1 + np.exp(-np.clip(worst(s)[0] + shift, -30, 30))))

        return score


class _Bags:
    """Labelled texts as one run of word numbers cut into windows, and the rows of each distinct word."""

    def __init__(self, texts):
        number: dict[str, int] = {}
        run, first, last, begins = array("i"), [], [], []
        windows_so_far = 0
        for t in texts:
            at = len(run)
            run.extend(number.setdefault(w, len(number)) for w in words_of(t))
            starts, ends = windows(len(run) - at)
            begins.append(windows_so_far)
            windows_so_far += len(starts)
            first.append(starts + at)
            last.append(ends + at)
        self.run = np.frombuffer(run, dtype=np.int32) if len(run) else np.zeros(0, dtype=np.int32)
        self.first, self.last, self.begins = np.concatenate(first), np.concatenate(last), np.array(begins)
        self.of_text = np.repeat(np.arange(len(texts)), np.diff([*begins, windows_so_far]))
        rows, sizes = array("i"), array("i")
        for w in number or ["?"]:
            at = rows_of(w)
            rows.extend(at)
            sizes.append(len(at))
        self.rows, self.sizes = np.frombuffer(rows, dtype=np.int32), np.frombuffer(sizes, dtype=np.int32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes, dtype=np.int64)[:-1]])

    def worst(self, row_scores):
        """Mean score, start and end of the worst window of each text."""
        words = np.add.reduceat(row_scores[self.rows], self.starts) / self.sizes
        total = np.concatenate([[0.0], np.cumsum(words[self.run])])
        means = (total[self.last] - total[self.first]) / np.maximum(self.last - self.first, 1)
        top = np.maximum.reduceat(means, self.begins)
        at = np.flatnonzero(means == top[self.of_text])
        _, one = np.unique(self.of_text[at], return_index=True)
        return top, self.first[at[one]], self.last[at[one]]

    def row_weights(self, first, last, pull):
        """Weight of each row when each text's pull is spread evenly over its window's words and their rows."""
        size = last - first
        place = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        words = np.bincount(self.run[place], np.repeat(pull / np.maximum(size, 1), size), minlength=len(self.sizes))
        some = np.flatnonzero(words)
        length = self.sizes[some]
        place = np.repeat(self.starts[some] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        return np.bincount(self.rows[place], np.repeat(words[some] / length, length), minlength=BUCKETS)


def fit(sample: list[tuple[bytes, int]], shares: tuple[int, int], seed: int = 7) -> Model:
    y = np.array([v for _, v in sample], dtype=float)
    n0, n1 = int((y == 0).sum()), int((y == 1).sum())
    prior = float(np.log((shares[1] + 0.5) / (shares[0] + 0.5)))
    if min(n0, n1) < 2:
        return Model(np.zeros((0, WIDTH)), np.zeros((2, WIDTH)), np.array([0.0, prior if sum(shares) else 0.0]))
    bags = _Bags([t.decode("utf-8", "replace") for t, _ in sample])
    weight = np.where(y == 1, shares[1] / n1, shares[0] / n0) * len(y) / sum(shares)
    aside = np.arange(len(y)) % 5 == 0  # the sample is in the order of a hash
    if min(y[~aside].sum(), (1 - y[~aside]).sum(), y[aside].sum(), (1 - y[aside]).sum()) < 1:
        aside[:] = False
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.1, (BUCKETS, WIDTH)), rng.normal(0, 0.3, (2, WIDTH)), np.array([0.0, prior])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    best, best_loss, best_step = None, np.inf, 0
    for step in range(1, STEPS + 1):
        table, classes, constant = params
        direction = classes[1] - classes[0]
        top, first, last = bags.worst(table @ direction)
        logit = top + constant[1] - constant[0]
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = -weight * (y * np.log(p) + (1 - y) * np.log1p(-p))
        watched = loss[aside].mean() if aside.any() else loss.mean()
        if watched < best_loss:
            best, best_loss, best_step = [q.copy() for q in params], watched, step
        elif step - best_step > PATIENCE:
            break
        pull = np.where(aside, 0.0, weight * (p - y)) / max((~aside).sum(), 1)
        on_rows = bags.row_weights(first, last, pull)
        to_direction = on_rows @ table
        grads = [on_rows[:, None] * direction + DECAY * table, np.stack([-to_direction, to_direction]) + DECAY * classes, np.array([-pull.sum(), pull.sum()])]
        for q, g, (m, v) in zip(params, grads, moments):  # Adam
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(best[0].astype(np.float32), best[1], best[2])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows, whatever the input

    def run(batches):
        of = shared.value.scorer()
        for batch in batches:
            s = pa.array([of(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], ["doc_id", "score"])

    out = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("body")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), PARTS, HELD_PART).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    return score(docs, fit(labelled_sample(docs, labels, label, PER_CLASS, CLASS_BYTES), label_counts(labels, label)))
