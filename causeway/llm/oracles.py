"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from causeway.llm.license_scan import HEADER, TEMPLATES

SPACED = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {}

ORACLES["op3_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
h AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS k FROM g),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM h),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM t, (SELECT unnest(range(5)) AS j) WHERE c > 1 GROUP BY doc_id),
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM x WHERE regexp_matches(line, '{SPACED}') GROUP BY doc_id),
m AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
s AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM b GROUP BY source),
p AS (SELECT avg(f / n) AS m, avg((f / n) * (f / n)) AS m2, avg(1 / n) AS inv FROM s),
v AS (SELECT m, CASE WHEN (m2 - m * m - m * (1 - m) * inv) / nullif(1 - inv, 0) > 1e-12
  THEN least(1000.0, greatest(m * (1 - m) / ((m2 - m * m - m * (1 - m) * inv) / (1 - inv)) - 1, 10.0)) ELSE 1000.0 END AS k FROM p),
y AS (SELECT source, (f + m * k) / (n + k) > 0.5 AS host_rejected FROM s, v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
  NOT base_failed AND NOT host_rejected AS kept
FROM b JOIN y ON b.source IS NOT DISTINCT FROM y.source
"""

ORACLES["op6_decontamination"] = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT item_id, least(len(w), 10) AS k, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS s FROM q),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
ks AS (SELECT DISTINCT k FROM wins),
p AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
m AS (SELECT doc_id, p.k, i, item_id FROM p JOIN wins ON p.k = wins.k AND array_to_string(list_slice(w, i, i + p.k - 1), ' ') = wins.s),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM (SELECT DISTINCT doc_id, k, i FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLES["op9_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{SPACED}'), []) AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
k AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS k FROM p),
t AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0),
b AS (SELECT doc_id, i AS at FROM t),
m AS (SELECT x.doc_id, x.word, x.i, b.at IS NOT NULL AND x.i < b.at + 35 AS gone
      FROM x ASOF LEFT JOIN b ON x.doc_id = b.doc_id AND x.i >= b.at),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

ORACLES["op10_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACED}'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON r.doc_id = e.a),
m AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""

_LINES = ", ".join(f"({k}, '{name}', '{line}')" for k, (name, lines) in enumerate(TEMPLATES.items()) for line in lines)

ORACLES["op8_license_scan"] = rf"""
WITH d AS (SELECT doc_id, concat_ws('/', coalesce(source, 'unknown'), coalesce(lang, 'unknown'), doc_id::VARCHAR) AS path, text,
  len(regexp_extract_all(text, '{SPACED}')) AS n_words FROM documents),
f AS (SELECT doc_id, n_words, unnest(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{HEADER}')))) AS header FROM d),
t AS (SELECT * FROM (VALUES {_LINES}) v(rank, license, header)),
h AS (SELECT header, count(*) AS copies FROM f GROUP BY header),
s AS (SELECT header, copies::DOUBLE AS copies FROM h UNION ALL SELECT header, 1.0 FROM t),
i AS (SELECT term, ln((1 + (SELECT sum(copies) FROM s)) / (1 + sum(copies))) + 1 AS idf
      FROM (SELECT copies, unnest(list_distinct(regexp_extract_all(lower(header), '[a-z0-9]+'))) AS term FROM s) GROUP BY term),
v AS (SELECT header, term, count(*) * idf AS w FROM (SELECT header, unnest(regexp_extract_all(lower(header), '[a-z0-9]+')) AS term
      FROM (SELECT header FROM h UNION SELECT header FROM t)) JOIN i USING (term) GROUP BY header, term, idf),
n AS (SELECT header, sqrt(sum(w * w)) AS norm FROM v GROUP BY header),
c AS (SELECT a.header, t.rank, t.license, round(sum(a.w * b.w) / (any_value(x.norm) * any_value(y.norm)), 6) AS cosine
      FROM h JOIN v a ON a.header = h.header JOIN v b ON a.term = b.term JOIN t ON t.header = b.header
      JOIN n x ON x.header = a.header JOIN n y ON y.header = b.header GROUP BY a.header, t.rank, t.license, t.header),
k AS (SELECT header, rank, license, cosine FROM c WHERE cosine >= 0.6 QUALIFY row_number() OVER (PARTITION BY header ORDER BY cosine DESC, rank) = 1),
o AS (SELECT doc_id, license, cosine, share FROM (SELECT *, sum(len(regexp_extract_all(header, '{SPACED}'))) OVER (PARTITION BY doc_id) >= 0.5 * n_words AS share,
        row_number() OVER (PARTITION BY doc_id ORDER BY cosine DESC, rank) AS rn FROM f JOIN k USING (header)) WHERE rn = 1),
p AS (SELECT d.doc_id, path, license, cosine, share, string_split(path, '/') AS parts FROM d LEFT JOIN o USING (doc_id)),
r AS (SELECT array_to_string(list_slice(parts, 1, len(parts) - 1), '/') AS dir, arg_min(license, doc_id) AS dir_license FROM p WHERE share GROUP BY 1),
a AS (SELECT doc_id, unnest(range(len(parts))) AS depth, parts FROM p WHERE license IS NULL),
b AS (SELECT doc_id, dir, dir_license FROM a JOIN r ON r.dir = array_to_string(list_slice(parts, 1, depth), '/')
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC) = 1)
SELECT doc_id, coalesce(license, dir_license) AS license, CASE WHEN license IS NOT NULL THEN 'own' WHEN dir_license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
  cosine, CASE WHEN license IS NULL THEN dir END AS license_dir
FROM p LEFT JOIN b USING (doc_id)
"""

ORACLES["op13_phrases"] = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g, count(*) AS f
      FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM g WHERE k > 1),
x AS (SELECT lang, g, f AS a, array_to_string(list_slice(w, 1, j), ' ') AS first, array_to_string(list_slice(w, j + 1, k), ' ') AS rest, j
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
y AS (SELECT x.lang, x.g, x.a, l.f AS l, r.f AS r, ((2000000::HUGEINT * x.a) // (l.f::HUGEINT + r.f))::BIGINT AS score, j
      FROM x JOIN g l ON l.lang = x.lang AND l.g = x.first JOIN g r ON r.lang = x.lang AND r.g = x.rest),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inner_ AS (SELECT lang, f, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2))),
dropped AS (SELECT DISTINCT z.lang, z.g FROM z JOIN inner_ USING (lang, g) WHERE 100::HUGEINT * inner_.f >= 80::HUGEINT * z.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM z ANTI JOIN dropped USING (lang, g) JOIN total USING (lang)
QUALIFY rank <= 2000
"""
