"""Tokens, pieces, packing and the lattice against libraries and plain sums."""

import hashlib
import math
import random
import struct
import re
from array import array
from collections import Counter, defaultdict
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spotfield.llm import lattice, packing, pieces
from spotfield.llm.queries import vocabulary

BPE, MODEL = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
PARTS = ["a", "b", " ", "  ", "\n", "é", "1", "'s", " ", " ", "!", "<|endoftext|>", "\x1c", "日", "▁", "ing", "the", "<s>", "\x00", "ⅷ", "😀", "\u0085"]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["", " ", "a  b", " a", "a ", "x" * 300, " " * 40, *("".join(rng.choice(PARTS) for _ in range(25)) for _ in range(n))]


def test_token_ids_are_the_library_s():
    ours, theirs = packing.Tokens(BPE), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in mixed(800, 1):
        assert list(array("I", ours.ids(t))) == theirs.encode(t, add_special_tokens=False).ids, t


def test_pieces_spans_and_text_are_the_library_s():
    ours, theirs = pieces.Pieces(MODEL), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for t in mixed(800, 2):
        ids = theirs.encode(t)
        found = ours.encode(t)
        assert [f[0] for f in found] == ids, t
        assert ours.decode(ids) == theirs.decode(ids)
        assert ours.digest(t)[:3] == (len(ids), h(",".join(map(str, ids))), h(theirs.decode(ids)))
        assert ours.digest(t)[3] == len(t.encode())
        assert [tuple(r) for r in ours.spans(t).tolist()] == found, t
        assert ours.digest(t)[4] == hashlib.sha256(struct.pack(f"<{3 * len(found)}q", *[v for f in found for v in f])).hexdigest()
        assert all(b == c for (_, _, b), (_, c, _) in zip(found, found[1:]) if c != found[0][1] and b <= c)
    rng = random.Random(4)
    for _ in range(300):
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(259) for _ in range(8)]
        assert ours.decode(ids) == theirs.decode(ids) == ours.spelled(np.array(ids), ids)


@pytest.mark.parametrize("text", ["", " ", "  ", "a ", " a", "a  b", "a   é b ", "\U0001f600 x\U0001f600", "x\u2581y z", "\u2581", "line\n\nnext \t tab", "\x00 \x01"])
def test_spans_of_runs_are_those_of_the_whole_text(text):
    """Every piece of a text gets the span that alignment of the whole text gives it, also through remembered runs."""
    p = pieces.Pieces(MODEL)
    for _ in range(2):
        found = p.spans(text)
        assert [tuple(r) for r in found.tolist()] == p.encode(text)
        assert p.spelled(found[:, 0], found[:, 0].tolist()) == p.decode(found[:, 0].tolist()) == text.replace("\u2581", " ")
    assert p.digest(text)[3] == len(text.encode())


def test_both_ways_to_merge_agree(monkeypatch):
    p, rng = pieces.Pieces(MODEL), random.Random(3)
    for _ in range(300):
        w = "".join(rng.choice(["▁", "th", "e", "r", "in", "g", "!", "é", "ABC", "▁▁"]) for _ in range(rng.randrange(1, 22)))
        monkeypatch.setattr(pieces, "SHORT", 48)
        short = p.merge(w)
        monkeypatch.setattr(pieces, "SHORT", 0)
        assert p.merge(w) == short and "".join(short) == w


def compiled_map(entries):
    """A character map as compiled models hold it, by first fit."""
    texts, at = b"", {}
    for key, new in entries.items():
        at[key.encode()] = len(texts)
        texts += new.encode() + b"\0"
    units, owner, values = [0] * 4096, {0: b""}, at
    children = defaultdict(set)
    for key in at:
        for i in range(len(key)):
            children[key[:i]].add(key[i])
        children[key].add(0)
    place = {b"": 0}
    base = 1
    for prefix in sorted(children, key=lambda k: (len(k), k)):
        here = place[prefix]
        labels = sorted(children[prefix])
        while base < 512 and any((here ^ base ^ c) in owner for c in labels):
            base += 1
        offset = base
        base = 1
        units[here] |= offset << 10
        for c in labels:
            node = here ^ offset ^ c
            owner[node] = prefix
            if c == 0:
                units[node] = values[prefix] | 1 << 31
                units[here] |= 1 << 8
            else:
                units[node] |= c
                place[prefix + bytes([c])] = node
    blob = np.array(units, dtype="<u4").tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


def test_character_map_takes_the_longest_prefix():
    m = pieces.CharacterMap(compiled_map({"ab": "X", "abc": "YZ", "é": "e", "ﬁ": "fi"}))
    assert m.longest(b"abcd", 0) == (3, b"YZ")
    assert m.longest(b"abd", 0) == (2, b"X")
    assert m.longest(b"a", 0) is None and m.longest(b"zab", 0) is None
    assert m.longest("é".encode(), 0) == (2, b"e")
    p = pieces.Pieces(MODEL)
    p.map = m
    normal, places = p.normalise("ﬁ éabc")
    assert normal == "▁fi▁eYZ"
    assert places == [0, 0, 0, 3, 4, 6, 6, 9]
    spans = p.encode("ﬁ éabc")
    assert spans[0][1] == 0 and spans[-1][2] == 9 and p.decode([s[0] for s in spans]) == "fi eYZ"


def test_piece_tables(spark, docs, rows, empty):
    got = pieces.decode(pieces.encode(docs, MODEL), MODEL).collect()
    assert Counter(r.text for r in got) == Counter(r[1] or "" for r in rows)
    assert pieces.digests(docs.withColumn("n_tokens", F.lit(1)), MODEL).count() == len(rows)
    digest = lambda i, s, e: hashlib.sha256(np.array([i, s, e], dtype="<i8").T.tobytes()).hexdigest()
    want = Counter(digest(r.ids, r.starts, r.ends) for r in pieces.encode(docs, MODEL).collect())
    assert Counter(r.spans_sha256 for r in pieces.digests(docs, MODEL).collect()) == want
    assert pieces.digests(empty, MODEL).count() == 0 and pieces.encode(empty, MODEL).count() == 0


def test_packing_places_every_token_once(docs, rows, empty):
    got = packing.pack(docs.withColumn("rank", F.lit("own")), BPE).toPandas()
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*theirs.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        whole = len(ids) // 2048 * 2048
        for s in [*range(0, whole, 2048), *([whole] if whole < len(ids) else [])]:
            part = ids[s:s + 2048]
            want[(i, s, len(part), crc32(part.tobytes()), len(ids))] += 1
    have = Counter((None if i != i else int(i), *map(int, rest)) for i, *rest in got[["doc_id", "start", "length", "ids_crc32", "doc_tokens"]].values)
    assert have == want
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert packing.pack(empty, BPE).count() == 0


@pytest.mark.parametrize("rest", [[5], [1500] * 300, [1025] * 200 + [700] * 200, list(range(1, 2048)), [1] * 5000])
def test_patterns_hold_every_piece(rest):
    sizes = packing.classes(2048)
    best = 1.0
    for cut in packing.cut_sizes(2048):
        counts = np.zeros(len(sizes), dtype=np.int64)
        for r in rest:
            counts[np.searchsorted(sizes, cut)] += r // cut
            if r % cut:
                counts[np.searchsorted(sizes, r % cut)] += 1
        planned = packing.plan(counts, 2048)
        assert (sum(p * c for p, c in planned) == counts).all()
        assert all(p @ sizes <= 2048 for p, _ in planned)
        best = min(best, packing.padding(planned, sum(rest), 2048))
    assert best < 0.03 or sum(rest) < 8192


def test_knapsack_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = np.sort(rng.choice(np.arange(1, 30), 6, replace=False))
        worth = rng.random(6) * sizes
        best = [0.0] * 61
        for c in range(1, 61):
            best[c] = max([best[c - 1], *(best[c - s] + w for s, w in zip(sizes, worth) if s <= c)])
        value, pattern = packing.knapsack(sizes, worth, 60)
        assert value == pytest.approx(best[60]) and pattern @ worth == pytest.approx(value) and pattern @ sizes <= 60


def test_forward_sums_all_segmentations(monkeypatch):
    names = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "bab"]
    rng = np.random.default_rng(1)
    weights = np.log(rng.dirichlet(np.ones(len(names) + 256)))
    la = lattice.Lattice(names, weights)
    p = dict(zip(names, np.exp(weights)))
    single = np.exp(weights[len(names):])

    @lru_cache(None)
    def total(s):
        if not s:
            return 1.0
        out = np.prod([single[b] for b in s[0].encode()]) * total(s[1:])
        return out + sum(p[n] * total(s[len(n):]) for n in names if s.startswith(n))

    counts, same = [0.0] * len(weights), [0.0] * len(weights)
    for word in ("", "a", "ababba", "é", "babab"):
        assert la.log_probability(word) == pytest.approx(math.log(total("▁" + word)))
    la.expect("abab", counts)
    monkeypatch.setattr(lattice, "SHORT", 0)
    la.expect("abab", same)
    assert counts == pytest.approx(same)
    step = 1e-6  # expected counts are slopes of the log probability
    for i, n in enumerate(names):
        other = weights.copy()
        other[i] += step
        slope = (lattice.Lattice(names, other).log_probability("abab") - la.log_probability("abab")) / step
        assert counts[i] == pytest.approx(slope, abs=1e-4), n


def test_lattice_scores(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lattice, "FREQUENT", 5)
    got = lattice.score(docs.withColumn("row", F.lit(1)).withColumn("c", F.lit(2)), MODEL).collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    held = lambda i: crc32(("" if i is None else str(i)).encode()) % 7 == 2
    seen = Counter(w for i, t, *_ in rows if not held(i) for w in words(t))
    ends = sum(not held(r[0]) for r in rows)
    n, v = sum(seen.values()) + ends, len(seen) + 1
    want = []
    for i, t, *_ in rows:
        w = words(t)
        base = math.log10((ends + 1) / (n + v + 1)) + sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in w)
        want.append((str(i), held(i), len(w) + 1, 1 + sum(x in seen for x in w), n, round(base, 4)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == sorted(want)
    assert all(r.score < 0 for r in got)
    assert lattice.score(empty, MODEL).count() == 0
    one = lattice.score(spark.createDataFrame([(9, "unseen words")], DOCS), MODEL).first()
    assert one.held_out == held(9) and one.score < 0


DOCS = "doc_id long, text string"
