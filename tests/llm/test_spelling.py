"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from spotfield.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lowered(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected(docs):
    counts = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 6 and k >= 5}
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def documents(seed, letters, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.choice([5, 6, 6, 7, 8, 9, 12, 17]))) for _ in range(n)]
    base += ["a" * 60, "b" * 47 + "c", "aa" * 12, "".join(rng.choice(letters) for _ in range(300))]

    def edited(w):
        i, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w + c, c + w])

    words, pool = [], list(base)
    for w in base:
        for _ in range(3):
            v = edited(w)
            pool += [v, edited(v)]
    for w in pool:
        words += [w.upper() if w.isascii() and rng.random() < 0.1 else w] * rng.choice([1, 5, 6, 9, 30, 160])
    rng.shuffle(words)
    docs = []
    while words:
        k = rng.randrange(1, 400)
        docs.append((len(docs), rng.choice(["", " ", "7"]).join(["", ""]) + rng.choice([" ", ", ", "_", " Ā", "1"]).join(words[:k])))
        words = words[k:]
    return docs + [(None, "strange strange strange strange strange strangee"), (None, None), (5, docs[5][1]), (7, ""), (8, " 中 ")]


@pytest.mark.parametrize("seed,letters,n,dictionary,size,pairs", [(0, "abcdéß", 150, 400, 4096, 1 << 18), (1, "ab", 120, 4000, 3, 50), (2, "abcdefghijklÿ", 300, 40, 2, 1 << 18)])
def test_variants_are_those_of_all_pairs(spark, monkeypatch, seed, letters, n, dictionary, size, pairs):
    monkeypatch.setattr(S, "DICTIONARY", dictionary)
    monkeypatch.setattr(S, "LIST", size)
    monkeypatch.setattr(S, "PAIRS", pairs)
    monkeypatch.setattr(S, "STRETCH", 50)
    docs = documents(seed, letters, n)
    got = S.variants(spark.createDataFrame([(i, t, "own") for i, t in docs], "doc_id long, text string, word string").repartition(3))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(docs)


def test_an_edit_changes_only_the_grams_it_touches():
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(6, 14))) for _ in range(300)]
    count = Counter(s[p:p + k] for w in words for s in [S.bracketed(w.encode())] for k in range(2, 9) for p in range(len(s) - k + 1))
    frequent = {g: c for g, c in count.items() if c > 20 and all(count[g[:k]] > 20 for k in range(2, len(g)))}
    frequent[b""] = 20
    for w in words:
        s = S.bracketed(w.encode())
        limit = S.limit_of(len(w))
        grams = S.decomposed(s, limit, frequent)
        pair = S.probes(s, grams, frequent)
        assert S.affected(pair) == 1 and S.affected(grams) < len(grams)
        i = rng.randrange(1, len(s) - 1)
        other = S.decomposed(s[:i] + b"z" + s[i:], limit, frequent)
        left = {(p, s[p:e]) for p, e in grams if e <= i}
        right = {(p + 1, s[p:e]) for p, e in grams if p >= i}
        t = s[:i] + b"z" + s[i:]
        assert left | right <= {(p, t[p:e]) for p, e in other}
        assert len(grams) - len(left | right) <= S.affected(grams)


def test_dictionary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(S, "DICTIONARY", 300)
    rng = random.Random(1)
    rows = [("".join(rng.choice("abcde") for _ in range(9)), 5) for _ in range(2000)]
    frequent = S.dictionary(spark.createDataFrame(rows, "word string, n long"))
    assert 10 < len(frequent) <= 301


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "short words only")], "doc_id long, text string")
    assert S.variants(docs).collect() == [] and S.variants(docs.where("doc_id < 0")).count() == 0
