"""Exact deduplication and personal data against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spotfield.llm import exact_dedup, pii
from spotfield.llm.common import attach

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    "a@b.com_x@y.org.z", "@@a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "+1 (234) 555-1234 call", "4111 1111 1111 1111 or 4111111111111112",
    "é😀 x@y.zz 10.0.0.1", "a." * 20_000 + "@x.y", "1" * 20_000, "1 " * 5000, "a@" + "b." * 9000 + "c", None, "", "+" * 3000, "4111111111111111x" * 500, "plain words"]


def luhn(digits):
    return sum((2 * d - 9 if d > 4 else 2 * d) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    out = []
    for no, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 14 <= len(digits) <= 19 and luhn(digits or "1"), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), no, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_spans_match_plain_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, start int")
    got = pii.report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain_spans(TEXTS[r.doc_id] or "")
        assert r.spans == want
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        kinds = Counter(s.split(":")[0] for s in want.split(",") if s)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in PLAIN]


@pytest.mark.parametrize("text,found", [
    ("iban GB82 WEST 1234 5698 7654 32.", True), ("GB82WEST12345698765432", True), ("GB82WEST12345698765431", False),
    ("hash GB82WEST12345698765432", False), ("hash of bank account GB82WEST12345698765432", True), ("xGB82WEST12345698765432", False)])
def test_account_numbers_need_checksum_and_context(spark, text, found):
    spans = pii.report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().spans
    assert ("iban:" in spans) == found


def test_redaction(spark, empty):
    rows = [(1, "write a@b.com_x@y.org now", 25), (2, "ip 10.0.0.1", 11), (3, None, None), (4, "clean", 99)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("cuts", F.lit("own"))
    got = {r.doc_id: (r.text, r.n_chars, r.cuts) for r in pii.redact(df).collect()}
    assert got == {1: ("write [EMAIL][EMAIL] now", 24, "own"), 2: ("ip [IP]", 7, "own"), 3: (None, None, "own"), 4: ("clean", 99, "own")}
    assert pii.redact(empty).columns == empty.columns and pii.report(empty).count() == 0


def expected_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return groups


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c), lambda c: F.lit(1)])
def test_assign(docs, rows, digest):
    groups = expected_groups(rows)
    got = sorted(map(repr, map(tuple, exact_dedup.assign(docs, digest=digest, salts=3).collect())))
    want = []
    for i, text, *_ in rows:
        ids = [j for j in groups[text or ""] if j is not None]
        keep = max(ids, default=None)
        want.append(repr((i, keep, len(groups[text or ""]), i == keep, hashlib.sha256((text or "").encode()).hexdigest())))
    assert got == sorted(want)


def test_survivors_keep_columns(spark, docs, rows, empty):
    extra = docs.withColumn("digest", F.lit("own")).withColumn("salt", F.map_from_arrays(F.array(F.lit("k")), F.array("doc_id")))
    kept = exact_dedup.survivors(extra).collect()
    groups = expected_groups(rows)
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(max((i for i in g if i is not None), default=None)) for g in groups.values())
    assert all(r.digest == "own" and r.salt == {"k": r.doc_id} for r in kept)
    assert {(r.doc_id, r.text) for r in kept} <= {(r[0], r[1]) for r in rows}
    assert exact_dedup.survivors(empty).columns == empty.columns and exact_dedup.assign(empty).count() == 0


@pytest.mark.parametrize("hot", [0, 1, 2, 50])
def test_attach_is_a_left_join(spark, hot):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 50 + [2] * 5 + [3, None, None, 9])], "k int, i int")
    groups = spark.createDataFrame([(1, 50, "a"), (2, 5, "b"), (3, 1, "c"), (4, 0, "d")], "k int, n long, v string")
    got = sorted(map(repr, map(tuple, attach(rows, groups, "k", "n", hot).collect())))
    want = sorted(map(repr, map(tuple, rows.join(groups, "k", "left").select("k", "i", "n", "v").collect())))
    assert got == want
