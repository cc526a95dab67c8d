"""Near copies of the pipeline against brute-force Jaccard."""

from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from spotfield.llm import minhash

SF = "/root/testdata/sf0.01"


def grams(text):
    parts = (text or "").encode().lower().split()
    return frozenset(tuple(parts[i:i + 5]) for i in range(max(1, len(parts) - 4))) if parts else frozenset()


def expected(rows):
    """Ids that stay: the smallest of each component at Jaccard 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    shared = {}
    for i, s in enumerate(sets):
        for g in s or {()}:
            shared.setdefault(g, []).append(i)
    for a, b in {p for group in shared.values() for p in combinations(group, 2)}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least, of = {}, {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
            of.setdefault(doc, []).append(find(i))
    return {doc for doc, at in of.items() if any(least[r] == doc for r in at)}


@pytest.fixture(params=[2048, 5])
def block(request, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", request.param)


def test_stage_keeps_what_brute_force_keeps(spark, rows, block):
    text = " ".join(f"word{i}" for i in range(300)).split()
    rng = np.random.default_rng(3)
    near = [(900 + k, " ".join(f"other{k}" if i in rng.choice(300, 1 + k % 6, replace=False) else w for i, w in enumerate(text)), "en", "s", 1) for k in range(24)]
    everything = rows + near
    docs = spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    want = expected([r[:2] for r in everything])
    assert kept - {None} == want and 900 in want and len(want & set(range(900, 924))) < 24


def test_what_no_fingerprint_or_key_proposes_is_found(spark, rows, monkeypatch):
    """Pairs of 0.8 or more that share no MinHash key and no SimHash component are links as well."""
    monkeypatch.setattr(minhash, "keys", lambda grams: [])
    monkeypatch.setattr(minhash, "proposed", lambda marked: marked.where("false").selectExpr("set", "set AS key"))
    text, rng = [f"word{i}" for i in range(300)], np.random.default_rng(4)
    near = [(900 + k, " ".join(f"other{k}" if i in rng.choice(300, 1 + k % 6, replace=False) else w for i, w in enumerate(text)), "en", "s", 1) for k in range(12)]
    # of nine shingles each two texts share eight: 0.8 exactly
    near += [(950, " ".join(text[:13]), "en", "s", 1), (951, " ".join([*text[:12], "end"]), "en", "s", 1)]
    everything = rows + near
    docs = spark.createDataFrame(everything, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = {r.doc_id for r in minhash.survivors(docs).collect()}
    want = expected([r[:2] for r in everything])
    assert kept - {None} == want and 950 in want and 951 not in want and len(want & set(range(900, 912))) < 12


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(5)
    for n in range(1, 60):
        a = np.unique(rng.integers(0, 1 << 40, n).astype(np.uint64))
        common = rng.integers(0, 3, minhash.CELLS)
        for gone in range(n // 5 + 1):
            b = np.sort(rng.permutation(a)[gone:])
            if len(b) >= 0.8 * len(a):
                assert np.intersect1d(minhash.prefix(a, common), minhash.prefix(b, common)).size
    assert not minhash.prefix(np.empty(0, np.uint64), common).size


def test_recall_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()}
    assert kept == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_group_links_join_what_all_pairs_join():
    rng = np.random.default_rng(1)
    for share in (0.02, 0.1, 0.2):
        base = np.arange(100, dtype=np.uint64)
        sets = [np.unique(np.where(rng.random(100) < share, rng.integers(1000, 9000, 100), base).astype(np.uint64)) for _ in range(60)]
        label = list(range(60))
        for a, b in combinations(range(60), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                label = [label[a] if x == label[b] else x for x in label]
        got = list(range(60))
        for a, b in minhash.group_links(sets):
            assert got[a] != got[b]
            got = [got[a] if x == got[b] else x for x in got]
        assert len(set(zip(label, got))) == len(set(label)) == len(set(got))


def test_fingerprints_propose(spark):
    """Sets in one component of SimHash fingerprints meet without any MinHash key; the exact similarity decides."""
    from pyspark.sql import functions as F

    from spotfield.llm import simhash
    from spotfield.runtime import materialise

    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(words[::-1]), "", " ", "a b"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    marked = materialise(minhash.marks(docs), "marks")
    assert {r.doc_id: r.fp & (2 ** 64 - 1) for r in marked.collect()} == {i: simhash.fingerprint(t.encode()) for i, t in enumerate(texts)}
    sets = marked.groupBy("set").agg(F.min("text_hash").alias("text_hash"), F.expr("cast(array() as array<long>)").alias("keys"))
    found = {frozenset((r.a, r.b)) for r in minhash.links(materialise(sets, "sets"), docs, minhash.proposed(marked)).collect()}
    by = {r.doc_id: r.set for r in marked.collect()}
    assert found == {frozenset((by[0], by[1]))}
