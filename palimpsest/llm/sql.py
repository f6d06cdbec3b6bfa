"""DuckDB SQL for the rows of those queries that SQL can express, on its own terms: no operator's code is in it."""

from __future__ import annotations

from .licences import PHRASES
from .urls import BLOCKED, RULES

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _string(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _any_case(words: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in words)


# Kind, pattern, group, least length of the group; Java's (?i) is ASCII only, RE2's is not.
_SECRETS = (
    ("assign", "(" + _any_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("vendor", r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----|sk_live_[A-Za-z0-9]{16,}", 0, 1),
)


def _found(k: int) -> str:
    kind, pattern, group, least = _SECRETS[k]
    p = _string(pattern)
    return f"""SELECT id, {k} AS o, '{kind}' AS kind, list_sum([length(x) FOR x IN gap[1:i]]) + coalesce(list_sum([length(x) FOR x IN hit[1:i - 1]]), 0) AS a, length(hit[i]) AS n
FROM (SELECT id, gap, hit, part, unnest(range(1, len(hit) + 1)) AS i FROM (SELECT id, string_split_regex(t, {p}) AS gap, regexp_extract_all(t, {p}, 0) AS hit, regexp_extract_all(t, {p}, {group}) AS part FROM d))
WHERE length(part[i]) >= {least}"""


_say = "string_agg(kind || ':' || CAST(a AS bigint) || ':' || CAST(a + n AS bigint), ',' ORDER BY a, o)"
SECRETS = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(map(_found, range(len(_SECRETS))))}),
g AS (SELECT id, {", ".join(f"count(*) FILTER (o = {k}) AS n_{_SECRETS[k][0]}" for k in range(3))}, {_say} FILTER (o < 3) AS base, {_say} AS spans FROM f GROUP BY id)
SELECT doc_id, {", ".join(f"coalesce(n_{_SECRETS[k][0]}, 0) AS n_{_SECRETS[k][0]}" for k in range(3))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (id)"""

NEAR = f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT id, doc_id, list_sort(CASE WHEN len(w) = 0 THEN CAST([] AS varchar[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END) AS s FROM w),
c AS (SELECT min(id) AS cls, s, min(doc_id) AS doc, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT cls, n, unnest(s) AS g FROM c),
l AS (SELECT a.cls AS a, b.cls AS b FROM x a JOIN x b ON a.g = b.g AND a.cls < b.cls GROUP BY a.cls, b.cls, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT cls, cls AS far FROM c UNION SELECT r.cls, e.b FROM r JOIN e ON r.far = e.a),
m AS (SELECT r.cls, min(c.doc) AS least FROM r JOIN c ON c.cls = r.far GROUP BY r.cls),
k AS (SELECT c.s, m.least FROM c JOIN m USING (cls))
SELECT doc_id, CAST(len(s.s) AS bigint) AS n_shingles, CASE WHEN len(s.s) = 0 THEN doc_id ELSE least END AS component_id, (len(s.s) = 0 OR doc_id IS NOT DISTINCT FROM least) AS kept FROM s LEFT JOIN k USING (s)"""

_ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_fits = [(v, h + p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in _ordered]
_words = [g.partition("\xff")[0].strip("*") for g in BLOCKED]
URLS = f"""WITH u AS (SELECT page_id, coalesce(regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*'), '') AS c, contains(url, '://') AS ok FROM pages),
p AS (SELECT page_id, CASE WHEN ok THEN translate(regexp_extract(c, '^[^/]*'), {_AZ}) ELSE '' END AS host, CASE WHEN ok THEN substr(c, length(regexp_extract(c, '^[^/]*')) + 1) ELSE '' END AS path FROM u),
r AS (SELECT page_id, host, path, CASE {" ".join(f"WHEN {f} THEN '{n}'" for _, n, f in _fits)} END AS rule, rtrim(lower(url_decode(regexp_replace(regexp_extract(host, '[^@]*$'), ':[0-9]*$', ''))), '.') AS plain FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{n}' THEN '{v}'" for v, n, _ in _fits)} WHEN {" OR ".join(f"contains(plain, '{w}')" for w in _words)} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


def _places(phrase: str, label: str) -> str:
    return f"SELECT id, '{label}' AS label, pos - 1 AS p FROM x WHERE " + " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(phrase.split()))


_longest = max(len(p.split()) for p, _ in PHRASES)
LICENCES = f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM d),
x AS (SELECT id, pos, {", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(_longest))} FROM t WINDOW o AS (PARTITION BY id ORDER BY pos)),
f AS ({" UNION ALL ".join(_places(*x) for x in PHRASES)}),
g AS (SELECT id, count(*) AS n, min(p) AS a, max(p) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM f GROUP BY id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(l, '') AS base_labels FROM d LEFT JOIN g USING (id)"""

_WORD = "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'"
# every alignment of a document and an item that share words, every window on it, and runs of windows that touch
LEAKS = f"""WITH dl AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, {_AZ}), {_WORD}) AS w FROM documents WHERE text IS NOT NULL),
bl AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, {_AZ}), {_WORD}) AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
d AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p FROM dl),
b AS (SELECT q, least(13, len(w)) AS size, (4 * least(13, len(w)) + 4) // 5 AS need, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS p FROM bl),
g AS (SELECT r, q, d.p - b.p AS shift, size, need, list(d.p ORDER BY d.p) AS ps FROM d JOIN b ON d.w = b.w GROUP BY r, q, d.p - b.p, size, need HAVING count(*) >= need),
h AS (SELECT * FROM g WHERE len([i FOR i IN range(1, len(ps) - need + 2) IF ps[i + need - 1] - ps[i] < size]) > 0),
s AS (SELECT r, q, shift, size, need, ps, unnest(range(greatest(0, shift), least(len(dl.w), shift + len(bl.w)) - size + 1)) AS s FROM h JOIN dl USING (r) JOIN bl USING (q)),
t AS (SELECT *, s - lag(s) OVER (PARTITION BY r, q, shift ORDER BY s) > size AS cut FROM s WHERE len([x FOR x IN ps IF x >= s AND x < s + size]) >= need),
u AS (SELECT *, count(*) FILTER (cut) OVER (PARTITION BY r, q, shift ORDER BY s) AS run FROM t),
v AS (SELECT r, q, shift, run, any_value(ps) AS ps, min(s) AS lo, max(s) + any_value(size) AS hi FROM u GROUP BY r, q, shift, run),
x AS (SELECT r, q, [y FOR y IN ps IF y >= lo AND y < hi] AS ps FROM v),
y AS (SELECT doc_id, item_id, ps[1] AS start_word, ps[len(ps)] + 1 - ps[1] AS n_words, len(ps) AS n_equal FROM x JOIN dl USING (r) JOIN bl USING (q)),
z AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_equal DESC, start_word, n_words) AS k FROM y)
SELECT doc_id, item_id, CAST(start_word AS bigint) AS start_word, CAST(n_words AS bigint) AS n_words, CAST(n_equal AS bigint) AS n_equal, n_equal / n_words AS similarity FROM z WHERE k = 1"""

# crc32 by its definition: a table from the polynomial, then byte by byte
SHARDS = """WITH tbl AS (SELECT list(c ORDER BY i) AS tbl FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, [CAST('0x' || x AS bigint) FOR x IN regexp_extract_all(hex(encode(coalesce(text, ''))), '..')] AS bytes, coalesce(CAST(doc_id AS varchar), 'null') AS k FROM documents),
c AS (SELECT doc_id, size, k, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, tbl[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tbl),
h AS (SELECT *, [CAST('0x' || substr(md5(k || ':' || i), 1, 13) AS bigint) FOR i IN range(9)] AS u FROM c),
s AS (SELECT *, CAST(list_position(u[1:8], list_max(u[1:8])) - 1 AS int) AS shard, CAST(list_position(u, list_max(u)) - 1 AS int) AS grown_shard FROM h)
SELECT doc_id, CAST(size AS bigint) AS size, CAST(text_crc32 AS bigint) AS text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY substr(md5(k || '/' || text_crc32), 1, 3), doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard FROM s"""

RESCAN = f"""WITH one AS (SELECT count(DISTINCT coalesce(text, '')) AS n FROM documents),
two AS (SELECT count(DISTINCT t) AS n FROM (SELECT coalesce(text, '') AS t FROM documents UNION ALL SELECT coalesce(text, '') || ' edited' FROM documents))
SELECT 1 AS scan, {len(_SECRETS)} * n AS n_pairs FROM one UNION ALL SELECT 2, 0 UNION ALL SELECT 3, {len(_SECRETS)} * (two.n - one.n) FROM one, two UNION ALL SELECT 4, n FROM two"""
