"""DuckDB SQL for the results of the operators that SQL can express."""

from __future__ import annotations

import math

from . import linededup, quality

WORD = r"[^\x20\x09-\x0D]+"

OP2 = rf"""
WITH cut AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL),
every AS (SELECT doc_id, unnest(p) AS raw, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS k FROM cut),
worded AS (SELECT doc_id, k, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(raw, '{WORD}')) AS n FROM every),
seq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS pos, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM worded WHERE n > 0),
docs AS (SELECT doc_id, list(line ORDER BY pos) AS lines FROM seq GROUP BY doc_id),
spans AS (SELECT a.doc_id, a.pos AS s, b.pos AS e FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {linededup.MIN_WORDS - 1} WHERE b.upto - a.upto + a.n >= {linededup.MIN_WORDS}),
blocks AS (SELECT doc_id, s, min(e) AS e FROM spans GROUP BY doc_id, s UNION SELECT doc_id, max(s), e FROM spans GROUP BY doc_id, e),
named AS (SELECT b.*, array_to_string(lines[s:e], chr(10)) AS content FROM blocks b JOIN docs USING (doc_id)),
first AS (SELECT content, min(row(doc_id, s)) AS f FROM named GROUP BY content HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM named JOIN first USING (content) WHERE row(doc_id, s) <> f),
lost AS (SELECT g.doc_id, g.pos, q.k, g.pos - row_number() OVER (PARTITION BY g.doc_id ORDER BY g.pos) AS run FROM gone g JOIN seq q USING (doc_id, pos)),
runs AS (SELECT doc_id, run, min(k) AS a, max(k) AS b FROM lost GROUP BY doc_id, run),
listed AS (SELECT doc_id, string_agg(a || '-' || b, ',' ORDER BY a) AS removed_runs FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY k) AS text FROM every ANTI JOIN lost USING (doc_id, k) GROUP BY doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM seq GROUP BY doc_id), losses AS (SELECT doc_id, count(*) AS n FROM lost GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(l.n, 0) AS n_removed, coalesce(removed_runs, '') AS removed_runs, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN losses l USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""

_FEATURES = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
_RATIO = {n: f"(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0.0 END)" for n, (a, b) in _FEATURES.items()}


def _bin(v: str) -> str:
    return f"(CASE WHEN {v} < {quality.LEAST} THEN 0 ELSE CAST(ceil(ln({v} / {quality.LEAST}) / {math.log(quality.GAMMA)!r}) AS INTEGER) + 1 END)"


def _value(b: str) -> str:
    return f"(CASE WHEN {b} <= 0 THEN 0.0 ELSE {quality.LEAST} * pow({quality.GAMMA}, {b} - 1.5) END)"


def _limits(name: str, source: str, by: list[str]) -> str:
    """Limits of each feature by group, from bins that are added up."""
    keys = "".join(f"{k}, " for k in by)
    group = ", ".join([*by, "feature"])
    most = " ".join(f"WHEN '{n}' THEN {above}" for n, (_, above) in quality.FEATURES.items())
    least = " ".join(f"WHEN '{n}' THEN {below}" for n, (below, _) in quality.FEATURES.items() if below is not None)
    return f"""
{name}_sum AS (SELECT {keys}feature, bin, sum(n) AS n FROM {source} GROUP BY ALL),
{name}_upto AS (SELECT *, sum(n) OVER (PARTITION BY {group}) AS total, sum(n) OVER (PARTITION BY {group} ORDER BY bin) AS upto FROM {name}_sum),
{name}_q AS (SELECT {keys}feature, max(total) AS n_docs, {", ".join(f"{_value(f'min(CASE WHEN upto >= {q} * total THEN bin END)')} AS q{k}" for k, q in ((1, 0.25), (2, 0.5), (3, 0.75)))} FROM {name}_upto GROUP BY ALL),
{name} AS (SELECT {keys}feature, n_docs, q2 + greatest(CASE feature {most} END, {quality.SPREAD} * (q3 - q2)) AS most, CASE WHEN feature = 'word_length' THEN q2 - greatest(CASE feature {least} END, {quality.SPREAD} * (q2 - q1)) END AS least FROM {name}_q)"""


OP7 = rf"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, w[i] || chr(0) || w[i + 1] || chr(0) || w[i + 2] AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, win FROM windows GROUP BY ALL HAVING count(*) > 1),
inside AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM windows JOIN twice USING (doc_id, win), (SELECT unnest([0, 1, 2]) AS o) GROUP BY doc_id),
lined AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM words),
stats AS (SELECT doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM words JOIN lined USING (doc_id) LEFT JOIN inside USING (doc_id)),
based AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM stats),
bins AS ({" UNION ALL ".join(f"SELECT lang, source, '{n}' AS feature, {_bin(r)} AS bin, count(*) AS n FROM based WHERE NOT base_failed GROUP BY ALL" for n, r in _RATIO.items())}),
{_limits("own", "bins", ["lang", "source"])},{_limits("langs", "bins", ["lang"])},{_limits("whole", "bins", [])},
picked AS (SELECT o.lang, o.source, o.feature,
  CASE WHEN o.n_docs >= {quality.MIN_DOCS} THEN o.most WHEN l.n_docs >= {quality.MIN_DOCS} THEN l.most ELSE w.most END AS most,
  CASE WHEN o.n_docs >= {quality.MIN_DOCS} THEN o.least WHEN l.n_docs >= {quality.MIN_DOCS} THEN l.least ELSE w.least END AS least
  FROM own o LEFT JOIN langs l ON o.lang IS NOT DISTINCT FROM l.lang AND o.feature = l.feature JOIN whole w ON o.feature = w.feature),
ratios AS ({" UNION ALL ".join(f"SELECT doc_id, lang, source, '{n}' AS feature, {r} AS v FROM based" for n, r in _RATIO.items())}),
inner_ AS (SELECT doc_id, bool_and(coalesce(v <= most, true) AND coalesce(v >= least, true)) AS ok FROM ratios r LEFT JOIN picked p ON r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source AND r.feature = p.feature GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ok AS kept FROM based JOIN inner_ USING (doc_id)"""

#: A pair of similarity 0.8 shares one of the rarest n - ceil(0.8 n) + 1 shingles of either set, so that only these are joined.
OP8 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(0) || w[i + 1])) END AS s FROM words),
flat AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, unnest(s) AS x FROM sets),
often AS (SELECT x, count(*) AS df FROM flat GROUP BY x),
ranked AS (SELECT doc_id, n, x, row_number() OVER (PARTITION BY doc_id ORDER BY df, x) AS r FROM flat JOIN often USING (x)),
rare AS (SELECT doc_id, n, x FROM ranked WHERE r <= n - (80 * n + 99) // 100 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
sized AS (SELECT p.a, p.b, len(sa.s) + len(sb.s) AS total, len(list_intersect(sa.s, sb.s)) AS shared FROM pairs p JOIN sets sa ON p.a = sa.doc_id JOIN sets sb ON p.b = sb.doc_id),
links AS (SELECT a, b FROM sized WHERE 100 * shared >= 80 * (total - shared)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, s.b FROM reach r JOIN sides s ON r.b = s.a),
found AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (doc_id)"""

#: SHA-1 in base 32: each five hexadecimal digits are four letters.
OP4 = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hashed AS (SELECT *, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS keeper FROM bodies),
lettered AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || h[5 * i + 1 : 5 * i + 5] AS BIGINT)) AS parts FROM hashed)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[k // 4 + 1] >> (15 - 5 * (k % 4))) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM lettered"""

_CASED = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_CASED})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_BASE = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}"}
#: The fixed patterns of the secret scan. Places follow from the lengths of the matches and of what is between them.
SECRET_BASE = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS ms, string_split_regex(text, '{p}') AS ps FROM t" for k, (kind, p) in enumerate(_BASE.items()))}),
e AS (SELECT doc_id, k, kind, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, ms[i] AS hit, CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1 : i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM e),
f AS (SELECT doc_id, k, kind, a, a + length(hit) AS b FROM s WHERE k > 0 OR length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS told FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256 FROM documents LEFT JOIN g USING (doc_id)"""

ORACLES = {"op2_line_dedup": OP2, "op4_warc_index": OP4, "op7_quality_rules": OP7, "op8_near_duplicates": OP8, "secret_base_spans": SECRET_BASE}
