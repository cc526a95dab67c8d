"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Four base kinds (email, ip, card, phone) follow fixed patterns and are kept
whatever their score.  Account numbers (``iban``) are added: proposed by a
pattern, confirmed by mod 97, and kept if their score reaches ``THRESHOLD``
after the words around them have been weighed.

Everything is a column expression.  ``regexp_extract_all`` gives the matches
and ``split`` by the same pattern the gaps between them; running sums of
their lengths are the positions, in code points.  Sums run within blocks of
``BLOCK`` matches, which keep only confirmed spans, and then over the blocks, so a
long text with very many matches takes time in proportion to them.  Redaction cuts
a text into stretches of ``STRETCH`` code points once and takes what lies between
spans from these.

Patterns are the plain ones below, written so that Java's matcher stays linear:
possessive repeats where nothing could be given back, and a start only where
the previous match ended or a run of the class begins, as a match further
inside a run implies one from its start.

Defined cases: a null text counts as empty and has no spans; every row gives
one row, repeated ids and null ids included; an empty table gives an empty
result; texts are taken whole, whatever their length; other columns are ignored,
or carried along by ``redact``, also where they are named like its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# length of an account number by country
LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG YE", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
    27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}


def _account(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{{groups}}}" + (f"\\x20?[A-Z0-9]{{{rest}}}" if rest else "")


# a token may follow, so the country tells where the number ends; other codes go on, up to a space before such a number
KNOWN = f"(?:{'|'.join(_account(n, c) for n, c in LENGTHS.items())})(?![A-Za-z0-9])"
OTHER = rf"[A-Z]{{2}}[0-9]{{2}}(?:(?:\x20(?!{KNOWN}))?[A-Z0-9]{{4}}){{2,7}}(?:(?:\x20(?!{KNOWN}))?[A-Z0-9]{{1,3}})?"

# fixed values: the kinds in their order, and the pattern of each
KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": f"(?:{KNOWN}|{OTHER})",
}
# a text without a match of this cannot have one of the pattern
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z][0-9]{2}"}
# score of a confirmed span before context, and words that raise or lower it
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7}
NEARBY = {
    "email": (r"\b(e-?mail|mail|contact|write|reply)\b", r"\b(example|noreply|image|version)\b"),
    "ip": (r"\b(ip|address|host|server|login|logged)\b", r"\b(version|release|section|chapter|v)\b"),
    "card": (r"\b(card|credit|debit|visa|mastercard|payment|karte|carte|tarjeta)\b", r"\b(order|isbn|serial|sku|tracking|ref)\b"),
    "phone": (r"\b(phone|tel|call|mobile|cell|fax|telefon|appel)\b", r"\b(order|serial|version|ref)\b"),
    "iban": (r"\b(iban|account|bank|bic|swift|transfer|konto|compte|cuenta)\b", r"\b(serial|sku|hash|part|model|token)\b"),
}
INSIDE = "[A-Za-z0-9]"  # an added span does not begin or end inside a word
RAISE, LOWER, THRESHOLD, REACH = 0.2, 0.3, 0.5, 40
BLOCK = 256     # matches in one running sum
STRETCH = 1024  # code points
SPANS = "array<struct<start:int,kind_no:int,end:int,kind:string,value:string,score:double>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    reverse = F.split(F.reverse(digits), "")

    def add(total, i):
        d = F.get(reverse, i).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """True where letters and digits pass the mod 97 check of account numbers."""
    moved = F.concat(F.substring(account, 5, 1 << 30), F.substring(account, 1, 4))

    def step(rest, c):
        letter = F.ascii(c) - 55
        return F.when(F.ascii(c) >= 65, (rest * 100 + letter) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


def confirmed(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2}|)"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "iban":
        return mod97(F.replace(value, F.lit(" "), F.lit("")))
    low, high = (14, 19) if kind == "card" else (10, 15)
    digits = _digits(value)
    right_length = F.length(digits).between(low, high)
    return F.when(right_length, luhn(digits)).otherwise(False) if kind == "card" else right_length


def _blocks_of(kind: str, found: Column, gaps: Column) -> Column:
    """array<struct<pos, out>> by block of matches: the block's length in code points, and its confirmed spans counted from its start."""
    good, bad = NEARBY[kind]

    def step(acc, i):
        gap, value = F.get(gaps, i), F.get(found, i)
        start = acc["pos"] + F.char_length(gap)
        end = start + F.char_length(value)
        around = F.lower(F.concat(F.substring(gap, -REACH, REACH), F.lit(" "), F.substring(F.get(gaps, i + 1), 1, REACH)))
        score = F.lit(PRIOR[kind]) + F.when(around.rlike(good), RAISE).otherwise(0.0) - F.when(around.rlike(bad), LOWER).otherwise(0.0)
        holds = confirmed(kind, value)
        if kind not in BASE:
            whole = ~F.substring(gap, -1, 1).rlike(INSIDE) & ~F.substring(F.get(gaps, i + 1), 1, 1).rlike(INSIDE)
            holds = holds & whole & (score >= THRESHOLD)
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"), value.alias("value"), score.alias("score"))
        return F.struct(end.alias("pos"), F.when(holds, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.expr(f"cast(array() as {SPANS})").alias("out"))

    def block(b):
        return F.aggregate(F.sequence(b * BLOCK, F.least((b + 1) * BLOCK, F.size(found)) - 1), zero, step)

    none = F.expr(f"cast(array() as array<struct<pos:int,out:{SPANS}>>)")
    last = F.floor((F.size(found) - 1) / BLOCK).cast("int")
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), last), block)).otherwise(none)


def _running(values: Column, first, join) -> Column:
    """array: for each value the ``join`` of ``first`` and all values before it, by blocks."""

    def onward(acc, v):
        return F.struct(join(acc["now"], v).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    def within(b):
        zero = F.struct(F.lit(first).alias("now"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(F.slice(values, b * BLOCK + 1, F.lit(BLOCK)), zero, onward)

    last = F.floor((F.size(values) - 1) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), within)

    def over(acc, b):
        shifted = F.transform(b["out"], lambda v: join(acc["now"], v))
        return F.struct(join(acc["now"], b["now"]).alias("now"), F.concat(acc["out"], F.array(shifted)).alias("out"))

    zero = F.struct(F.lit(first).alias("now"), F.expr("cast(array() as array<array<int>>)").alias("out"))
    return F.flatten(F.aggregate(blocks, zero, over)["out"])


def with_spans(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """(doc, body, spans): each row of ``docs`` as a struct, its text, and all spans by start and kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), text.alias("body"))
    empty = F.expr("cast(array() as array<string>)")
    for k in kinds:
        hint = F.col("body").contains(HINTS[k]) if k == "email" else F.col("body").rlike(HINTS[k])
        out = out.withColumn(f"m_{k}", F.when(hint, F.regexp_extract_all("body", F.lit(PATTERNS[k]), F.lit(0))).otherwise(empty))
    for k in kinds:
        out = out.withColumn(f"g_{k}", F.when(F.size(f"m_{k}") > 0, F.split("body", PATTERNS[k], -1)).otherwise(empty))
    for k in kinds:
        out = out.withColumn(f"b_{k}", _blocks_of(k, F.col(f"m_{k}"), F.col(f"g_{k}")))

    def moved(block, by):
        return F.transform(block["out"], lambda s: F.struct(
            (s["start"] + by).alias("start"), s["kind_no"].alias("kind_no"), (s["end"] + by).alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), s["score"].alias("score")))

    for k in kinds:
        blocks = F.col(f"b_{k}")
        starts = _running(F.transform(blocks, lambda b: b["pos"]), 0, lambda a, b: a + b)
        out = out.withColumn(f"s_{k}", F.when(F.size(blocks) > 0, F.flatten(F.zip_with(blocks, starts, moved))).otherwise(F.expr(f"cast(array() as {SPANS})")))
    return out.select("doc", "body", F.sort_array(F.concat(*[F.col(f"s_{k}") for k in kinds])).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans) per row."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE))

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select(F.col("doc.doc_id").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one.

    ``n_chars``, where there is one, is brought up to date.
    """
    found = with_spans(docs)

    some = F.size("spans") > 0
    none = F.expr("cast(array() as array<int>)")
    # where the text before a span has been used up to: the largest end so far
    used = F.when(some, _running(F.transform("spans", lambda s: s["end"]), 0, F.greatest)).otherwise(none)
    stretches = F.when(some, F.regexp_extract_all("body", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))
    out = found.withColumn("used", used).withColumn("stretches", stretches)

    def between(a, b):
        """Code points from ``a`` to before ``b``."""
        first, last = F.floor(a / STRETCH).cast("int"), F.floor(b / STRETCH).cast("int")
        within = F.substring(F.get("stretches", first), a % STRETCH + 1, b - a)
        head = F.substring(F.get("stretches", first), a % STRETCH + 1, F.lit(STRETCH))
        tail = F.when(b % STRETCH == 0, "").otherwise(F.substring(F.get("stretches", last), F.lit(1), b % STRETCH))
        across = F.concat(head, F.array_join(F.slice("stretches", first + 2, last - first - 1), ""), tail)
        return F.when(a >= b, "").when(first == last, within).otherwise(across)

    def piece(s, before):
        kept = F.concat(between(before, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.when(s["start"] >= before, kept).otherwise("")  # a span that overlaps one before it is part of it

    end = F.greatest(F.element_at("used", -1), F.element_at("spans", -1)["end"])
    pieces = F.array_join(F.zip_with("spans", "used", piece), "")
    clean = F.when(some, F.concat(pieces, between(end, F.char_length("body")))).otherwise(F.col("doc.text"))
    out = out.withColumn("clean", clean)
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        new["n_chars"] = F.when(some, F.char_length("clean").cast(kind)).otherwise(F.col("doc.n_chars"))
    return out.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
