"""DuckDB SQL of the queries that SQL can express: the rules, the chat digests and the archive's records."""

from __future__ import annotations

from .quality_rules import BOILERPLATE, MARKS, NAVIGATION_MARKS, SYMBOLS
from .queries import CONTROL

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _solid(x: str) -> str:
    return f"length(translate({x}, {WS}, ''))"


def _count(x: str, marks: str) -> str:
    return f"(length({x}) - length(translate({x}, {_quoted(marks)}, '')))"


RULES = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: {_solid("x")} > 0) AS l
  FROM d),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT i + k) AS n FROM r, (VALUES (0), (1), (2)) AS v(k) GROUP BY rid),
c AS (
  SELECT w.*, coalesce(n.n, 0) AS n_repeat_words,
         list_filter(l, lambda x: NOT ({_count("x", MARKS)} > 0.08 * {_solid("x")}
           OR ({_count("x", NAVIGATION_MARKS)} >= 3 AND 40 * {_count("x", NAVIGATION_MARKS)} >= {_solid("x")})
           OR ({_solid("x")} <= 240 AND ({" OR ".join(f"contains(lower(x), {_quoted(b)})" for b in BOILERPLATE)})))) AS good
  FROM w LEFT JOIN n USING (rid)),
b AS (
  SELECT *, CAST(len(w) AS BIGINT) AS n_words, CAST({_solid("t")} AS BIGINT) AS word_chars,
         len(w) < 50 OR 100 * n_repeat_words > 50 * len(w) AS base_failed
  FROM c)
SELECT doc_id, n_words, word_chars, CAST({_count("t", SYMBOLS)} AS BIGINT) AS n_symbols,
       CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND {_solid("array_to_string(good, chr(10))")} >= 0.5 * word_chars AS kept
FROM b
"""

CHAT = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {_quoted(CONTROL)} UNION ALL SELECT -7, 1, 'assistant', {_quoted(CONTROL)})
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(4 + length(regexp_replace(role, '\\\\|###|</turn>|:', '-\\0', 'g')) + 2
              + length(regexp_replace(text, '\\\\|###|</turn>', '-\\0', 'g')) + 8) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

ARCHIVE = """
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT *, strlen(body) AS n, sha1(body) AS digest FROM p),
f AS (SELECT *, first_value(rid) OVER w AS first_rid, first_value(page_id) OVER w AS first_id
      FROM q WINDOW w AS (PARTITION BY digest, n ORDER BY page_id DESC NULLS LAST, rid DESC))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND rid <> first_rid THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND rid <> first_rid THEN first_id END AS refers_to
FROM f
"""


COLLOCATIONS = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d),
w AS (SELECT lang, list_filter(string_split_regex(p, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w[i] AS x, CASE WHEN i + 1 <= len(w) THEN w[i + 1] END AS y, CASE WHEN i + 2 <= len(w) THEN w[i + 2] END AS z FROM i),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
c1 AS (SELECT lang, x, count(*) AS f FROM g GROUP BY ALL),
c2 AS (SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL),
c3 AS (SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inner_pairs AS (SELECT lang, x, y, max(f) AS longer FROM (SELECT lang, x, y, f FROM c3 UNION ALL SELECT lang, y, z, f FROM c3) GROUP BY ALL),
cuts AS (
  SELECT p.lang, p.x || ' ' || p.y AS phrase, p.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM c2 p JOIN c1 l ON l.lang = p.lang AND l.x = p.x JOIN c1 r ON r.lang = p.lang AND r.x = p.y
  LEFT JOIN inner_pairs o ON o.lang = p.lang AND o.x = p.x AND o.y = p.y
  WHERE p.f >= 10 AND (o.longer IS NULL OR 100 * o.longer < 50 * p.f)
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 1, l.f, r.f
  FROM c3 t JOIN c1 l ON l.lang = t.lang AND l.x = t.x JOIN c2 r ON r.lang = t.lang AND r.x = t.y AND r.y = t.z
  UNION ALL
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z, t.f, 2, l.f, r.f
  FROM c3 t JOIN c2 l ON l.lang = t.lang AND l.x = t.x AND l.y = t.y JOIN c1 r ON r.lang = t.lang AND r.x = t.z),
s AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


DIVERGENCE = """
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, lang, source, unnest(list_filter(string_split_regex(t, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n_lang FROM k GROUP BY lang),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(sum(c.n), 0)::HUGEINT AS n_group FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.n_group + l.v) AS p,
         1 + (1000000000::HUGEINT * (k.total + 1)) // (l.n_lang + l.v) AS q
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""

EMBEDDINGS = """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT *, len(e) AS dim FROM d
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
half AS (
  SELECT a.rid AS x, b.rid AS y FROM ok a JOIN ok b ON a.label = b.label AND a.dim = b.dim AND a.rid < b.rid
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)) >= 0.93),
links AS (SELECT x, y FROM half UNION ALL SELECT y, x FROM half),
reach AS (SELECT rid AS x, rid AS y FROM d UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
c AS (SELECT r.x AS rid, min(d.vec_id) AS component_id FROM reach r JOIN d ON d.rid = r.y GROUP BY r.x),
n AS (SELECT x AS rid, count(*) AS n FROM links GROUP BY x)
SELECT d.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, coalesce(d.vec_id = c.component_id, FALSE) AS kept
FROM d JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": CHAT, "op8_quality_rules": RULES, "op9_warc": ARCHIVE, "op11_embeddings": EMBEDDINGS, "op12_collocations": COLLOCATIONS, "op13_divergence": DIVERGENCE}
