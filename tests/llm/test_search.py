"""Near duplicates, top-k, archives, classifiers and the pipeline against brute force or held-out labels."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from test_near import expected as kept_by_jaccard
from spotfield.llm import exact_dedup, graph, pii, quality, simhash, topk, toxicity, warc

SF = "/root/testdata/sf0.001"


# near duplicates

def plain_fingerprint(text, words=4):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(parts[i:i + words]) for i in range(len(parts) - words + 1)] or ([" ".join(parts)] if parts else [])
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_roots(values, distance):
    values = sorted(values)
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if (a ^ b).bit_count() <= distance and (x := find(a)) != (y := find(b)):
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def clustered(seed, n):
    """Chains and stars of close values, values that share many bits, and strangers."""
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for _ in range(n // 4):
        v = rng.getrandbits(64)
        for _ in range(6):
            out.add(v)
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                v ^= 1 << b
    top = rng.getrandbits(40)
    out |= {top << 24 | rng.getrandbits(24) for _ in range(n)}
    return out


@pytest.mark.parametrize("partitions,bucket", [(2, 1 << 14), (3, 1 << 14), (3, 8), (4, 50), (5, 1 << 14)])
def test_links_find_every_pair(spark, monkeypatch, partitions, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    values = clustered(partitions, 120)
    signed = [(int(np.uint64(v).astype(np.int64)),) for v in values]
    found = simhash.links(spark.createDataFrame(signed, "fp long").repartition(3), 4, partitions)
    roots = graph.components(found, "a", "b").collect()
    classes = defaultdict(set)
    for r in roots:
        classes[r.root].add(r.node & (1 << 64) - 1)
    want = defaultdict(set)
    for v, root in plain_roots(values, 4).items():
        want[root].add(v)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_allocation_is_optimal():
    rng = np.random.default_rng(0)
    costs = [rng.random((6, 30)) for _ in range(3)]
    got = simhash.allocate(costs, 5)
    for row in range(30):
        best = min(sum(c[u, row] for c, u in zip(costs, units)) for units in [(a, b, 5 - a - b) for a in range(6) for b in range(6 - a)])
        assert sum(c[u, row] for c, u in zip(costs, got[row])) == pytest.approx(best) and got[row].sum() == 5


def test_candidate_estimate_counts_rings():
    histogram = np.arange(16.0)
    table = simhash.candidate_table(histogram, 4, 3)
    for cell in range(16):
        for radius in range(3):
            assert table[radius + 1, cell] == pytest.approx(sum(histogram[c] for c in range(16) if (c ^ cell).bit_count() <= radius))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 300: 300, 301: 300}
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_assign_near_duplicates(spark, docs, rows, empty):
    text = next(r[1] for r in rows if r[1] and len(r[1].split()) > 80)
    near = [(900 + k, text + f" extra{k}", "en", "src0", 1) for k in range(4)]
    more = docs.unionByName(spark.createDataFrame(near, docs.schema)).withColumn("fp", F.lit("own")).withColumn("n", F.lit(0))
    everything = rows + near
    prints = [plain_fingerprint(r[1]) for r in everything]
    root = plain_roots(set(prints), 4)
    least = {}
    for r, p in zip(everything, prints):
        if r[0] is not None:
            least[root[p]] = min(least.get(root[p], r[0]), r[0])
    want = sorted((str(r[0]), f"{p:016x}", least.get(root[p])) for r, p in zip(everything, prints))
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.assign(more).collect())
    assert got == want
    kept = sorted(r.doc_id for r in simhash.survivors(more).where("doc_id IS NOT NULL").select("doc_id").distinct().collect())
    assert kept == sorted(set(least.values()))
    assert simhash.survivors(empty).count() == 0 and simhash.assign(empty).count() == 0


# top k

def plain_top(vectors, k, every):
    good = [(i, [int(np.floor(np.float64(x) * 256)) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in {i: max(v for j, v in good if j == i) for i, _ in good if i % every == 0}.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("n,shard,block", [(3, 4096, 64), (300, 64, 8), (300, 4096, 64)])
def test_top_k(spark, monkeypatch, n, shard, block):
    monkeypatch.setattr(topk, "SHARD", shard)
    rng = np.random.default_rng(n)
    vectors = [(int(i), [float(x) for x in np.round(rng.normal(0, 0.2, 6), 1).astype(np.float32)]) for i in range(n)]
    vectors += [(1000, None), (1001, [None] * 6), (1002, [float("nan")] * 6), (1003, [float("inf")] + [0.0] * 5), (1004, [0.5]), (1006, []), (None, [1.0] * 6)]
    vectors += [(i, v) for i, v in vectors[1:40]]  # repeated rows
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("shard", F.lit("own")).repartition(3)
    vectors = [(r.vec_id, r.embedding) for r in df.collect()]
    got = sorted(map(tuple, topk.top(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_top(vectors, 5, 10)


def test_blocks_are_pruned_and_large_values_exact():
    rng = np.random.default_rng(0)
    rows = np.sort(rng.integers(0, 1000, (4096, 1)), axis=0) * np.ones((1, 8), dtype=np.int64)
    q, name, score = topk.search(np.array([-1]), np.ones((1, 8), dtype=np.int64), np.arange(4096), rows, 5)
    assert list(score) == sorted(rows.sum(axis=1))[::-1][:5]
    big = np.array([[3 << 40, 5], [3 << 40, 6]], dtype=np.int64)
    _, name, score = topk.search(np.array([9]), np.array([[1 << 20, 1]], dtype=np.int64), np.array([1, 2]), big, 2)
    assert list(zip(name, score)) == [(2, (3 << 60) + 6), (1, (3 << 60) + 5)]


def test_few_shards_are_visited(spark, monkeypatch):
    """Clustered vectors: most shards cannot reach a query's k-th score and are not asked."""
    monkeypatch.setattr(topk, "SHARD", 50)
    monkeypatch.setattr(topk, "PACK", 7)
    monkeypatch.setattr(topk, "QUERIES", 11)
    rng = np.random.default_rng(3)
    vectors = []
    for i in range(3000):
        v = rng.normal(0, 0.02, 16)
        v[i % 16] += 1.0 if i % 32 < 16 else -1.0
        vectors.append((i, [float(x) for x in v.astype(np.float32)]))
    trace = []
    got = sorted(map(tuple, topk.top(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0, trace=trace).collect()))
    assert got == plain_top(vectors, 5, 20)
    visited, every = trace[0]
    assert every >= 150 * 60 and 5 * visited < every


def test_top_k_of_nothing(spark):
    assert topk.top(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


# archives

def test_archives_round_trip(spark, tmp_path):
    long_page = "<p>" + "é\r\n\r\n" * 400
    pages = [(1, "http://b.example.com/x?q=1#top", "short"), (2, "https://www.a.example.com", long_page), (5, "http://a.example.com/", long_page), (4, None, long_page),
             (None, "http://c.org/a b\r\nX: y", long_page), (6, "", None), (7, "http://a.example.com/", ""), (7, "http://a.example.com/", ""), (8, "http://z.com/", "w" * 1000),
             (9, "http://z.com/", "w" * 1000), (9, "http://z.com/", "w" * 1000)] + [(100 + i, "http://hot.com/", f"page {i}") for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("own")).withColumn("content", F.lit(1)).repartition(4)
    folder = str(tmp_path / "archives")
    warc.write(df, folder, per_archive=7)
    runs = warc.read(spark, folder)
    index = warc.merge(runs, entries=10)
    got = index.collect()
    assert len(got) == len(pages) and len({r.archive for r in got}) > 1
    keys = [(r.urlkey, r.timestamp, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and index.rdd.getNumPartitions() > 1
    groups = defaultdict(list)
    for i, _, html in pages:
        groups[html or ""].append(i)
    want = []
    for i, _, html in pages:
        body = (html or "").encode()
        keep = max((j for j in groups[html or ""] if j is not None), default=None) if len(body) >= 1000 and len(groups[html or ""]) > 1 else None
        again = keep is not None and keep != i
        want.append((str(i), len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keep if again else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=lambda w: w[:4])
    assert {r.urlkey for r in got if r.page_id in (1, 2, 4)} == {"com,example,b)/x?q=1", "com,example,a)/", "urn:page:4"}
    blob = spark.read.format("binaryFile").load(folder).first().content
    offset, head, http, payload = next(warc.parse(bytes(blob)))
    assert offset == 0 and head["WARC-Type"] in ("response", "revisit") and "Content-Length" in http
    with pytest.raises(ValueError):
        list(warc.parse(bytes(blob)[:-40]))


def test_loser_tree_merges():
    rng = random.Random(0)
    for k in (0, 1, 2, 5, 9):
        runs = [sorted(((str(rng.randrange(9)), "", rng.randrange(9), "", 0, "", None, f"a{i}", j) for j in range(rng.randrange(7))), key=warc.order) for i in range(k)]
        assert list(warc.LoserTree(runs)) == sorted((e for r in runs for e in r), key=warc.order)


def test_no_pages(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# classifiers

def labelled(spark, seed=0, n=1500):
    rng = random.Random(seed)
    syllables = "th er on in re an st ti ed ing at or es".split()
    bad_words = ["idiot", "moron", "worthless"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5)))
    docs, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 300))]
        q, t = int(rng.random() > 0.25), int(rng.random() < 0.3)
        if t:
            for _ in range(rng.randrange(1, 4)):
                w = rng.choice(bad_words)
                if i % 3 == 0:  # misspelt
                    j = rng.randrange(1, len(w) - 1)
                    w = w[:j] + w[j + 1:] if rng.random() < 0.5 else w[:j] + w[j] + w[j:]
                words.insert(rng.randrange(len(words)), w)
        if not q:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [w + rng.choice(["***", "$$$", "%%%"]) for w in words]
        docs.append((i, " ".join(words)))
        labels.append((i, q, t))
    docs += [(n, None), (n + 1, ""), (3, docs[3][1])]
    labels += [(n, 1, 0), (n + 5, 1, 1), (n + 1, None, None), (None, 1, 1)]
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("own")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.fixture(scope="module")
def marked(spark):
    return labelled(spark)


@pytest.mark.parametrize("kind,label,threshold", [(quality, "quality", 0.5), (toxicity, "toxic", 0.7)])
def test_classifier_on_held_out_rows(marked, kind, label, threshold):
    docs, labels = marked
    got = kind.classify(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and truth.get(r.doc_id) is not None]
    right = sum(a == b for a, b in held) / len(held)
    assert right > (0.93 if label == "quality" else 0.88)
    kept = [b for a, b in held if a == (1 if label == "quality" else 0)]
    assert (sum(kept) if label == "quality" else len(kept) - sum(kept)) / len(kept) > 0.97


@pytest.mark.parametrize("kind", [quality, toxicity])
def test_classifier_without_labels(spark, marked, empty, kind):
    docs, labels = marked
    none = kind.classify(docs.limit(5), labels.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}
    assert kind.classify(empty, labels).count() == 0
    one = kind.classify(docs.limit(5), labels.where("quality = 1 AND toxic = 1")).collect()
    assert all(r.score > 0.5 for r in one)


def test_accepted_rows_are_the_predicted_ones(marked):
    docs, labels = marked
    kept = Counter(r.doc_id for r in quality.accepted(docs, labels).collect())
    assert kept == Counter(r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted)


# pipeline

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, SF).collect(), docs.schema)
        seen[name] = {r.doc_id: r for r in now.collect()}
        assert now.columns == docs.columns
    start = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert set(seen["quality"]) == {r.doc_id for r in quality.classify(docs, labels).collect() if r.predicted}
    keep = {}
    for i, r in seen["quality"].items():
        keep[r.text] = max(i, keep.get(r.text, i))
    assert set(seen["exact_dedup"]) == set(keep.values())
    assert set(seen["near_dedup"]) == kept_by_jaccard([(i, r.text) for i, r in seen["exact_dedup"].items()])
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for i, r in seen["pii"].items():
        assert (r.text == start[i].text) == (not spans[i]) and r.n_chars == len(r.text)
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF)
    lengths = {r.doc_id: (r.n, r.t) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert set(lengths) == set(seen["pii"]) and all(n == t for n, t in lengths.values())
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == packed.count()


def test_empty_pipeline(spark, empty):
    now = empty
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
    assert exact_dedup.survivors(empty).count() == 0
