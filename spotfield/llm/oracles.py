"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from .pii import LENGTHS

OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


def _spans(kind: str, no: int, pattern: str, good: str, base: bool = True, text: str = "t") -> str:
    """Spans of one kind: gaps and matches of a pattern, positions as running sums of their lengths."""
    return f"""
SELECT doc_id, {no} AS no, '{kind}' AS kind, {'true' if base else 'false'} AS base, s AS s, s + length(m) AS e FROM (
  SELECT doc_id, t, i, m, gap, next_gap, CAST(sum(length(gap)) OVER w + coalesce(sum(length(m)) OVER v, 0) AS BIGINT) AS s FROM (
    SELECT doc_id, t, i, m[i] AS m, g[i] AS gap, g[i + 1] AS next_gap FROM (
      SELECT doc_id, t, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g, t FROM d)))
  WINDOW w AS (PARTITION BY doc_id ORDER BY i), v AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE {good}"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse({_DIGITS})[i] AS INT)
  WHEN CAST(reverse({_DIGITS})[i] AS INT) > 4 THEN 2 * CAST(reverse({_DIGITS})[i] AS INT) - 9 ELSE 2 * CAST(reverse({_DIGITS})[i] AS INT) END)) % 10 = 0"""
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# a marked text has the length of the original, from which the words around a span are taken
_BEFORE, _AFTER = "substr(t, 1 + s - least(length(gap), 40), least(length(gap), 40))", "substr(t, 1 + s + length(m), least(length(next_gap), 40))"
_NEAR = f"lower({_BEFORE} || ' ' || {_AFTER})"
_ACCOUNT = "replace(replace(m, ' ', ''), chr(1), '')"
# letters of an account number are numbers of two digits, marked by 1000
_MOD97 = f"""list_reduce(list_prepend(0, list_transform(string_split({_ACCOUNT}[5:] || {_ACCOUNT}[:4], ''), lambda c: CASE WHEN ascii(c) >= 65
  THEN 1000 + ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, c: CASE WHEN c >= 1000 THEN (a * 100 + c - 1000) % 97 ELSE (a * 10 + c) % 97 END) = 1"""

_IBAN = f"""{_MOD97} AND NOT regexp_matches(right({_BEFORE}, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left({_AFTER}, 1), '[A-Za-z0-9]')
  AND (regexp_matches({_NEAR}, '\\b(iban|account|bank|bic|swift|transfer|konto|compte|cuenta)\\b')
    OR NOT regexp_matches({_NEAR}, '\\b(serial|sku|hash|part|model|token)\\b'))"""


def _known(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[ \\x01]?[A-Z0-9]{{4}}){{{groups}}}" + (f"[ \\x01]?[A-Z0-9]{{{rest}}}" if rest else "")


# there is no look-ahead: "_" becomes "~", so that a word boundary is the end of letters and digits, and a space before a number of a known
# country becomes chr(1), which numbers of other countries do not go across; numbers within numbers take further turns
_KNOWN = f"(?:{'|'.join(_known(n, c) for n, c in LENGTHS.items())})\\b"
_ANY = f"(?:{_KNOWN}|[A-Z][A-Z][0-9][0-9](?: ?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"
_MARKED = "replace(coalesce(text, ''), '_', '~')"
for _ in range(4):
    _MARKED = f"regexp_replace({_MARKED}, ' ({_KNOWN})', chr(1) || '\\1', 'g')"

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_MARKED} AS marked FROM documents),
spans AS (
{_spans('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+', 'true')}
UNION ALL {_spans('ip', 1, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+', f"regexp_full_match(m, '{_OCTET}(?:[.]{_OCTET}){{3}}')")}
UNION ALL {_spans('card', 2, '[0-9](?:[ -]?[0-9])+', f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}")}
UNION ALL {_spans('phone', 3, '[+][0-9][ ().0-9-]+[0-9]', f"length({_DIGITS}) BETWEEN 10 AND 15")}
UNION ALL {_spans('iban', 4, _ANY, _IBAN, False, 'marked')}
),
by_doc AS (
SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (base) AS base_spans,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS all_spans
FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(all_spans, '') AS spans
FROM d LEFT JOIN by_doc ON d.doc_id = by_doc.doc_id
"""

OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS response FROM p WHERE strlen(html) >= 1000 GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM p LEFT JOIN g ON p.html = g.html
"""

OP4 = """
WITH v AS (
SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)))),
s AS (
SELECT q.vec_id AS query_id, d.vec_id, CAST(list_sum(list_transform(range(1, len(q.c) + 1), lambda i: q.c[i] * d.c[i])) AS BIGINT) AS score
FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM benchmark),
n AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM n)),
grams AS (SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS words FROM (
  SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
hits AS (SELECT row, i, g.k, item_id FROM grams g JOIN windows v ON g.k = v.k AND g.words = v.words),
hit_words AS (SELECT row, count(DISTINCT word) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS word FROM hits) GROUP BY row),
items AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (
  SELECT DISTINCT row, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (row) LEFT JOIN items USING (row)
"""



def _kmeans(k: int, rounds: int, dimension: int) -> str:
    """Rounds of assignment and update, written out; comparisons go through exact whole numbers."""

    def assigned(t: int) -> str:
        return f"""d{t} AS MATERIALIZED (SELECT row, c, d FROM (SELECT row, c, d, row_number() OVER (PARTITION BY row ORDER BY d, c) AS turn FROM (
  SELECT v.row, m.c, CAST(list_sum(list_transform(list_zip(v.cells, m.cells), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{t} m)) WHERE turn = 1)"""

    parts = [f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({256} * CAST(x AS DOUBLE)) AS BIGINT)) AS cells FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {dimension} AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))))""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY name, cells) - 1 AS c, cells FROM (
  SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS name, cells FROM v ORDER BY name, cells LIMIT {k}))"""]
    for t in range(rounds):
        parts += [assigned(t), f"""c{t + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.cells, m.cells) AS cells FROM c{t} m LEFT JOIN (
  SELECT c, list((s - (s % n + n) % n) // n ORDER BY j) AS cells FROM (
    SELECT c, j, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT d.c, unnest(range({dimension})) AS j, unnest(v.cells) AS x FROM d{t} d JOIN v ON d.row = v.row) GROUP BY c, j)
  GROUP BY c) u ON m.c = u.c)"""]
    parts.append(assigned(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(d.c AS INT) AS cluster, d.d AS distance, CAST(sum(d.d) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia, CAST(sum(d.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m.cells, ',')) AS centroid_sha256
FROM d{rounds} d JOIN v ON d.row = v.row JOIN c{rounds} m ON d.c = m.c
"""


OP12 = _kmeans(40, 5, 64)



def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        for _ in range(8):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        table.append(i)
    return table


_BYTES = """flatten(list_transform(string_split({0}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
  ELSE [192 + (unicode(c) >> 6), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))"""
_CRC = f"""xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {_BYTES}), lambda a, x: xor(a >> 8, CAST({_crc_table()}[1 + (xor(a, x) & 255)] AS BIGINT))), 4294967295)"""

OP13 = f"""
WITH r AS MATERIALIZED (SELECT doc_id, run, count(*) AS n FROM (
  SELECT doc_id, {_LOWER.format("unnest(regexp_extract_all(text, '[A-Za-z\\x{C0}-\\x{FF}]+'))")} AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT run, n, {_CRC.format("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM r),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
v AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)),
near AS (
SELECT x.word, y.word AS near, y.n AS m FROM v x JOIN v y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
UNION SELECT x.word, y.word, y.n FROM v x JOIN w y ON x.a || x.b = y.word
UNION SELECT y.word, x.word, x.n FROM v x JOIN w y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM near GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * w.n THEN near END AS form, CASE WHEN m >= 5 * w.n THEN m END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word),
chain AS (
  WITH RECURSIVE steps AS (
    SELECT word, word AS root, 0 AS depth FROM f
    UNION ALL SELECT s.word, f.form, depth + 1 FROM steps s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL)
  SELECT word, arg_max(root, depth) AS root FROM steps GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain ON f.word = chain.word
"""

ORACLES = {"op1_warc": OP1, "op4_topk": OP4, "op5_pii": OP5, "op6_exact_dedup": OP6, "op11_wumanber": OP11, "op12_centroids": OP12, "op13_variants": OP13}
