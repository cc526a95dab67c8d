"""Account numbers before a token of capitals or digits."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from spotfield.llm import pii
from spotfield.llm.oracles import OP5


def account(country, length):
    """A number of this length whose check digits pass mod 97."""
    body = "".join(str((7 * i + length) % 10) for i in range(length - 4))
    plain = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(plain) % 97:02d}{body}"


def spaced(number):
    return " ".join(number[i:i + 4] for i in range(0, len(number), 4))


ALL = [(n, c) for n, cs in pii.LENGTHS.items() for c in cs.split()]


def test_numbers_before_capitals_and_digits(spark):
    texts, want = [], []
    for n, c in ALL:
        for number in (account(c, n), spaced(account(c, n))):
            for tail in (" BIC CAIXESBB", " EUR", " TOTAL 500", " 500", " 1234 5678 9012", ".", ""):
                texts.append(f"IBAN {number}{tail}")
                want.append(f"iban:5:{5 + len(number)}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("iban:")] for r in pii.report(docs).collect()}
    assert {texts[i]: got[i] for i in got} == {t: [w] for t, w in zip(texts, want)}


@pytest.mark.parametrize("text,count", [
    ("IBAN ES9121000418450200051332 BIC CAIXESBB", 1), ("account AT61 1904 3002 3457 3201 EUR", 1), ("bank AT611904300234573201 TOTAL 500", 1),
    ("IBAN ES91 2100 0418 4502 0005 1332 AT61 1904 3002 3457 3201 SWIFT", 2), ("konto NR12 3456 7890 ES9121000418450200051332 EUR", 1),
    ("IBAN ES9121000418450200051333 BIC", 0), ("IBAN ES9121000418450200051332Q", 0), ("IBAN XES9121000418450200051332 EUR", 0),
])
def test_redacted(spark, text, count):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(docs).select(F.size(F.split("text", r"\[IBAN\]")) - 1).first()[0] == count


def test_sql_has_the_same_rule(spark):
    texts = [f"IBAN {number}{tail}" for n, c in ALL for number in (account(c, n), spaced(account(c, n))) for tail in (" BIC CAIXESBB", " 1234 5678", "_x", "")]
    texts += [f"{a} {b}" for a in ("ZZ12 3456 7890 12", "ES91 2100", "hash_iban", "hash iban_", "part", "X") for b in (spaced(account("ES", 24)), spaced(account("AT", 20)) + " " + spaced(account("DE", 22)))]
    texts += [account("ES", 24) + "_", "é_" + account("FR", 27) + " é", "DE12 " + spaced(account("AT", 20)), "", None, "a@b.cc AT61 1904 3002 3457 3201 +1 234 567 8901"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    cursor = con.execute(OP5)
    names = [c[0] for c in cursor.description]
    want = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cursor.fetchall()}
    for r in pii.report(docs).collect():
        assert r.asDict() == want[r.doc_id], texts[r.doc_id]


def test_long_texts_take_time_in_proportion(spark):
    numbers = "".join(f"{i % 97:02d} entry{i % 10} " for i in range(200_000))
    mails = "".join(f"é user{i}@host.example, " for i in range(20_000))
    docs = spark.createDataFrame([(1, numbers), (2, mails)], "doc_id long, text string")
    begin = time.time()
    got = {r.doc_id: r for r in pii.report(docs).collect()}
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert time.time() - begin < 60  # a fold that copies all spans takes hours
    assert got[1].spans == "" and got[2].n_email == 20_000 and got[2].spans.endswith(f":{len(mails) - 2}")
    assert clean == {1: numbers, 2: "é [EMAIL], " * 20_000}


@pytest.mark.parametrize("block,stretch", [(1, 1), (2, 3), (256, 1024)])
def test_redaction_joins_overlapping_spans(spark, monkeypatch, block, stretch):
    monkeypatch.setattr(pii, "BLOCK", block)
    monkeypatch.setattr(pii, "STRETCH", stretch)
    texts = ["ip 10.0.0.1, +10.0.0.1 (234) 555-1234 and 4111 1111 1111 1111.a@b.cc", "1.2.3.4@x.yy 😀 5.6.7.8", "😀a@b.cc😀", "+49 30 1234567 8.8.8.8", "none", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: [s.split(":") for s in r.spans.split(",") if s] for r in pii.report(docs).collect()}
    for r in pii.redact(docs).collect():
        want, at = "", 0
        for kind, a, b in spans[r.doc_id]:
            if int(a) >= at:
                want += texts[r.doc_id][at:int(a)] + f"[{kind.upper()}]"
            at = max(at, int(b))
        assert r.text == (want + texts[r.doc_id][at:] if spans[r.doc_id] else texts[r.doc_id])
