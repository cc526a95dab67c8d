"""Benchmark passages against a plain search for every window."""

import hashlib
import random
import re

import pytest

from spotfield.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(docs, items):
    windows = {}
    for item, text in items:
        w = lowered(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i:i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        w = lowered(text)
        hit, found = set(), set()
        for k in {len(v) for v in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i:i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i:i + k])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables(seed, vocabulary):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)] + ["Ünder", "naïve", "42", "ÀB"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", " ", ", ", ".\n", "_", "-"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 2, 3, 9, 10, 11, 30]) if i % 3 else 25)) for i in range(30)]
    items += [(50, None), (51, ""), (52, "..."), (None, text(12)), (3, text(15)), (53, items[0][1]), (54, "w0")]
    docs = [(i, text(rng.randrange(120))) for i in range(80)]
    for i in range(40):
        item = rng.choice(items)[1] or ""
        docs.append((100 + i, text(rng.randrange(20)) + " " + item.upper() + " " + text(5) + item[len(item) // 2:] + " " + text(8)))
    docs += [(None, items[4][1]), (7, items[5][1]), (7, docs[7][1]), (200, None), (201, ""), (202, " \n.-"), (203, "w1 " * 3000 + items[0][1] + " x" * 3000)]
    return docs, items


@pytest.mark.parametrize("vocabulary,block,stretch", [(6, 1 << 24, 1 << 20), (40, 300, 64), (3000, 1 << 24, 100)])
def test_hits_are_those_of_a_plain_search(spark, monkeypatch, vocabulary, block, stretch):
    monkeypatch.setattr(decontaminate, "STRETCH_BYTES", stretch)
    docs, items = tables(vocabulary, vocabulary)
    left = spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, items string").repartition(3)
    right = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string").repartition(2)
    got = decontaminate.report(left, right, block)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs, items)


def test_ranges_are_disjoint_and_in_order(spark):
    docs, items = tables(1, 8)
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    for r in decontaminate.spans(left, right, 400).collect():
        flat = [x for s in r.ranges for x in (s.start, s.stop)]
        assert flat == sorted(flat) and len(set(flat)) == len(flat) and all(x <= r.n_words for x in flat)


def test_shift_skips_words():
    items = [" ".join(f"b{i}x{j}" for j in range(12)) for i in range(20)]
    block = decontaminate.Block(__import__("pickle").dumps((["a"] * 20, [t.encode() for t in items])))
    asked = []

    def number(word):
        asked.append(word)
        return block.numbers.get(word)

    block.searchers[0].search([b"other"] * 10_000, number)
    assert len(asked) <= 1001


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in decontaminate.report(docs, items).collect()} == {0}
    assert decontaminate.report(docs.where("doc_id < 0"), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
