"""Scores of the two classifiers against plain loops over the fitted models."""

import math
import re
from zlib import crc32

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from spotfield.llm import quality, toxicity

SF = "/root/testdata/sf0.001"


def plain_quality(model, text):
    body = (text or "").encode()
    sizes = []
    for d in (model.good, model.bad):
        learned = zstandard.ZstdCompressionDict(d)
        learned.precompute_compress(level=3)
        total = 0
        for i in range(0, len(body), 1024):
            one = zstandard.ZstdCompressor(dict_data=learned, write_content_size=False, write_dict_id=False, write_checksum=False)
            total += len(one.compress(body[i:i + 1024]))
        sizes.append(total)
    good, bad = sizes
    x = (bad - good) / (bad + good) if body else 0.0
    ratio = min((bad + good) / (2 * len(body)), 1.0) if body else 1.0
    short = 64 / (64 + len(body))
    w = model.weights
    return 1 / (1 + math.exp(-(w[0] * x + w[1] * ratio + w[2] * short + w[3] * x * short + w[4])))


def plain_toxicity(model, text):
    """The softmax of every window of six words, three apart, from averaged vectors; the largest."""
    words, vectors = re.findall(r"[^\W_]+", (text or "").lower()), []
    for word in words:
        marked = f"<{word}>"
        grams = [marked] + [marked[i:i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
        vectors.append(np.mean([model.embeddings[crc32(g.encode()) % 65536].astype(float) for g in grams], axis=0))
    best, start = 0.0, 0
    while start == 0 or start + 3 < len(words):
        window = vectors[start:start + 6]
        logits = model.classes @ (np.mean(window, axis=0) if window else np.zeros(8)) + model.constant
        e = np.exp(logits - logits.max())
        best = max(best, e[1] / e.sum())
        start += 3
    return best


@pytest.mark.parametrize("kind,label,plain,threshold", [(quality, "quality", plain_quality, 0.5), (toxicity, "toxic", plain_toxicity, 0.7)])
def test_scores_are_those_of_a_plain_loop(spark, kind, label, plain, threshold):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (-1, ""), (-2, "\U0001f600"), (-3, "word " * 30_000), (-3, "word " * 30_000), (-4, " \n"), (-5, "seven words stand in this short line")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("score", F.lit("own")).withColumn("body", F.lit(1))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = kind.fit(quality.labelled_sample(docs, labels, label), quality.label_counts(labels, label))
    got = kind.score(docs, model).collect()
    texts = docs.select("doc_id", "text").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(((r.doc_id, plain(model, r.text)) for r in texts), key=key)
    have = sorted(((r.doc_id, r.score) for r in got), key=key)
    assert [i for i, _ in have] == [i for i, _ in want]
    assert [s for _, s in have] == pytest.approx([s for _, s in want], abs=1e-6)
    for r in got:
        assert r.predicted == int(r.score >= threshold) and 0 <= r.score <= 1
        assert r.doc_id is None or r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)
    assert kind.score(docs.limit(0), model).count() == 0
