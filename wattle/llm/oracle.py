"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from . import url_filter as _u
from .common import WORD

ORACLE: dict[str, str] = {}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _hit(term: str) -> str:
    return f"regexp_matches(u, '(^|[^\\pL\\pN]){term}([^\\pL\\pN]|$)')"


def _count(term: str) -> str:
    """Occurrences of a term that no letter or digit touches."""
    n, touch = len(term), r"'[\pL\pN]'"
    return (f"CASE WHEN contains(u, '{term}') THEN len(list_filter(range(1, length(u) + 1), lambda i: substr(u, i, {n}) = '{term}' "
            f"AND NOT regexp_matches(CASE WHEN i > 1 THEN substr(u, i - 1, 1) ELSE '' END, {touch}) "
            f"AND NOT regexp_matches(substr(u, i + {n}, 1), {touch}))) ELSE 0 END")


def _url_sql() -> str:
    rules = ", ".join(f"({_quoted(r.host)}, {_quoted(r.path)}, {_quoted(r.verdict)})" for r in _u.RULES)
    soft = " + ".join(f"{_hit(t)}::INT" for t in _u.SOFT)
    strict = " + ".join(_count(t) for t in _u.STRICT)
    return f"""
WITH r(h, p, v) AS (VALUES {rules}),
p AS (SELECT page_id, url,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
        translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u
      FROM pages),
m AS (SELECT page_id, host, path, u,
        (SELECT max_by(r.h || r.p, length(r.h || r.p)) FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS rule,
        (SELECT max_by(r.v, length(r.h || r.p)) FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) AS v,
        ({strict})::INT AS strict_hits, ({soft})::INT AS soft_hits
      FROM p)
SELECT page_id, host, path, rule,
       coalesce(v, CASE WHEN strict_hits > 0 OR soft_hits >= {_u.SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       strict_hits, soft_hits
FROM m"""


ORACLE["op8_url_filters"] = _url_sql()

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_FOLDED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), " + _LOWER + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE["op10_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_FOLDED_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM s, unnest(range(1, len(w) - k + 2)) AS u(i)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, ks, unnest(range(1, greatest(1, len(w) - k + 2))) AS u(i)),
h AS (SELECT doc_id, i, dw.k AS k, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM h, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)"""

ORACLE["op3_source_mix"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w,
        2.0 * source_size AS cap FROM s),
r AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
        sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_after,
        1.5 * sum(source_size) OVER () AS budget FROM o),
l AS (SELECT arg_min((budget - cap_before) / w_after, cap / w) FILTER (WHERE (budget - cap_before) / w_after <= cap / w) AS lam FROM r),
t AS (SELECT source, source_size, least(cap, lam * w) AS target FROM r, l),
q AS (SELECT *, least(floor(target + 0.5)::BIGINT, 2 * source_size) AS take FROM t),
f AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS full_copies FROM q),
c AS (SELECT d.doc_id, d.size, f.source_size, f.target, f.full_copies, f.take - f.full_copies * f.source_size AS rest,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('0:' || coalesce(d.doc_id::VARCHAR || ':', '') || d.size::VARCHAR)
                          ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (full_copies + CASE WHEN rest > 0 AND 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c"""

# an independent form: prefixes of single words, counted exactly
ORACLE["op1_line_dedup"] = r"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, list_distinct(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS s
      FROM t, unnest(range(1, len(ls) + 1)) AS u(i)),
n AS (SELECT *, len(s) AS n, row_number() OVER (ORDER BY doc_id, i) AS o FROM l WHERE len(s) > 0),
w AS (SELECT o, n, unnest(s) AS w FROM n),
f AS (SELECT w, count(*) AS df FROM w GROUP BY w),
r AS (SELECT o, n, w.w, row_number() OVER (PARTITION BY o ORDER BY df, w.w) AS k FROM w JOIN f USING (w)),
p AS (SELECT * FROM r WHERE k <= n - ceil(0.8 * n - 0.000001) + 1),
c AS (SELECT DISTINCT a.o AS a, b.o AS b FROM p a JOIN p b ON a.w = b.w AND a.o < b.o AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
m AS (SELECT DISTINCT b FROM c JOIN n x ON x.o = a JOIN n y ON y.o = b
      WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
g AS (SELECT doc_id, list(i) AS gone FROM n JOIN m ON n.o = m.b GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF NOT list_contains(coalesce(gone, []), i)], chr(10)), '')) AS text_sha256
FROM t LEFT JOIN g ON t.doc_id = g.doc_id"""

ORACLE["op6_ngram_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE [array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)] END) AS g FROM d),
n AS (SELECT doc_id, g, len(g) AS n FROM s),
t AS (SELECT doc_id, n, unnest(g) AS g FROM n),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.other) AS component_id FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n"""


def _license_sql() -> str:
    from . import licenses as m

    words = ", ".join(f"({i}, {_quoted(name)}, {_quoted(w)}, {n})"
                      for i, (name, text) in enumerate(m.TEMPLATES) for w, n in m.template_words(text).items())
    return rf"""
WITH v(i, licence, w, n) AS (VALUES {words}),
f AS (SELECT doc_id, string_split(text, chr(10)) AS ls,
        coalesce(source, 'unknown') || CASE WHEN doc_id % 10000 < 100 THEN '' WHEN doc_id % 100 < 10 THEN '/' || (doc_id // 10000)
            ELSE '/' || (doc_id // 10000) || '/' || (doc_id // 100) END AS dir FROM documents),
u AS (SELECT doc_id, pos, regexp_extract_all(lower(ls[pos]), '[\p{{L}}\p{{N}}]+') AS ws FROM f, unnest(range(1, len(ls) + 1)) AS x(pos)),
k AS (SELECT doc_id, pos, w, count(*) AS n FROM (SELECT doc_id, pos, unnest(ws) AS w FROM u) GROUP BY ALL),
t AS (SELECT count(*) AS total FROM u WHERE len(ws) > 0),
idf AS (SELECT v.w, ln((1 + any_value(total)) / (1 + count(k.n))) + 1 AS idf FROM (SELECT DISTINCT w FROM v) v LEFT JOIN k ON k.w = v.w, t GROUP BY v.w),
vn AS (SELECT i, any_value(licence) AS licence, sqrt(sum((n * idf) * (n * idf))) AS norm FROM v JOIN idf USING (w) GROUP BY i),
len AS (SELECT doc_id, pos, sqrt(sum((n * coalesce(idf, ln(1 + total) + 1)) ** 2)) AS norm FROM k LEFT JOIN idf USING (w), t GROUP BY doc_id, pos),
dot AS (SELECT k.doc_id, k.pos, v.i, sum(k.n * idf * v.n * idf) AS dot FROM k JOIN v ON k.w = v.w JOIN idf ON idf.w = k.w GROUP BY ALL),
sc AS (SELECT doc_id, pos, licence, dot / len.norm / vn.norm AS score FROM dot JOIN len USING (doc_id, pos) JOIN vn USING (i)),
own AS (SELECT doc_id, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos, licence) AS r
        FROM sc WHERE score >= 0.6) WHERE r = 1),
o AS (SELECT f.doc_id, f.dir, own.licence, own.score FROM f LEFT JOIN own USING (doc_id)),
dec AS (SELECT dir, licence FROM (SELECT dir, licence, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, licence) AS r
        FROM o WHERE licence IS NOT NULL GROUP BY dir, licence) WHERE r = 1),
up AS (SELECT doc_id, dec.licence, dec.dir AS from_dir, row_number() OVER (PARTITION BY doc_id ORDER BY length(dec.dir) DESC) AS r
       FROM o JOIN dec ON o.dir = dec.dir OR starts_with(o.dir, dec.dir || '/'))
SELECT o.doc_id, o.dir || '/' || o.doc_id AS path, coalesce(o.licence, up.licence) AS licence,
       CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN up.licence IS NOT NULL THEN 'inherited' END AS how,
       round(o.score, 6) AS score, CASE WHEN o.licence IS NULL THEN up.from_dir END AS from_dir
FROM o LEFT JOIN up ON o.doc_id = up.doc_id AND r = 1"""


ORACLE["op2_license_scan"] = _license_sql()

# CRC-32 of bytes, by its polynomial: a table of 256 remainders, then one step for each byte
_STEP = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
_CRC_TABLE = "list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda x, y: " + _STEP.format("x") + "))"


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; ``crc_table`` is a column ``tab`` in scope."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda o: ('0x' || o)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


ORACLE["op13_sharding"] = f"""
WITH crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, strlen(t) + 1 AS size, {_crc("t")} AS crc, coalesce('s' || source, 'null') AS s FROM d, crc),
k2 AS (SELECT *, md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, 'null'), size, crc, s)) AS key FROM k),
f AS (SELECT *, (row_number() OVER (PARTITION BY s ORDER BY key) - 1 + (('0x' || substr(md5(s), 1, 5))::BIGINT + 0.5::DOUBLE) / 1048576)
        / count(*) OVER (PARTITION BY s) AS fraction FROM k2),
g AS (SELECT *, row_number() OVER (ORDER BY fraction, s, key) - 1 AS pos, count(*) OVER () AS n FROM f),
h AS (SELECT *, pos * 8 // n AS shard FROM g)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INT AS shard,
       (pos - (shard * n + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM h"""

ORACLE["op11_prefix_trie"] = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_CRC_TABLE} AS tab),
d AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, length(role) || ':' || role || text AS t, role, text,
        len(regexp_extract_all(text, '{WORD}')) AS w,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text)) AS pos FROM d),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_crc("conv_id::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM d), crc),
r AS (SELECT c.conv_id, o.pos, t, w FROM c JOIN o ON o.conv_id = c.base WHERE o.pos <= c.h
      UNION ALL
      SELECT c.conv_id, o.pos - c.h + (SELECT count(*) FROM o b WHERE b.conv_id = c.base AND b.pos <= c.h), t, w
      FROM c JOIN o USING (conv_id) WHERE o.pos > c.h),
s AS (SELECT c.conv_id, coalesce(list(r.t ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS seq,
             coalesce(list(r.w ORDER BY r.pos) FILTER (r.pos IS NOT NULL), []) AS ws
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
m AS (SELECT conv_id, depth, seq[1:depth] AS p, seq[1:depth - 1] AS up, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w, len(seq) = depth AS ends
      FROM s, unnest(range(0, len(seq) + 1)) AS u(depth)),
n AS (SELECT p, depth, any_value(up) AS up, any_value(w) AS w, min(conv_id) AS conv_id, count(*) AS n_convs,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM m GROUP BY p, depth),
k AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
t AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children, q.conv_id AS parent_conv_id
      FROM n LEFT JOIN k ON k.up = n.p AND k.depth = n.depth
      LEFT JOIN n q ON n.depth > 0 AND q.p = n.up AND q.depth = n.depth - 1),
x AS (SELECT a.conv_id, a.depth, sum((b.n_convs - 1) * b.w) AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
      FROM t b, unnest(range(0, b.depth + 1)) AS u(l) JOIN t a ON a.depth = l AND a.p = b.p[1:l] GROUP BY a.conv_id, a.depth)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM t JOIN x USING (conv_id, depth)"""

_TERMS = "regexp_extract_all(translate(text, " + _LOWER + r"), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE["op12_source_audit"] = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT i, lang, source, unnest({_TERMS}) AS term FROM d),
v AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN v USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, count(*) AS v, sum(n) AS n FROM v GROUP BY lang),
t AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
        (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (coalesce(t.n, 0) + s.v)) AS p,
        (1 + 1000000000::HUGEINT * (v.n + 1) // (s.n + s.v)) AS q
      FROM g JOIN s USING (lang) JOIN v USING (lang) LEFT JOIN t ON t.lang = g.lang AND t.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200"""
