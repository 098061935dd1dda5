"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from gleaner.llm import mixing, secrets

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP2 = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST(greatest(coalesce(ceil(length(translate(text, '{mixing.MARKS}', '')) / greatest(length(text), 1) * {mixing.GRADES}), 1), 1) AS INTEGER) AS grade,
    (CAST('0x' || substr(md5('{mixing.SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), levels AS (
  SELECT *, source_size * 3 AS cap, source_size * 3 / w AS ratio, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (
      ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (
      ORDER BY source_size * 3 / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, least(w * (SELECT arg_min(level, ratio) FROM levels WHERE level <= ratio), cap) AS target FROM levels
), k AS (
  SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
    coalesce(CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) * {mixing.GRADES} / d.grade ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM k)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _matches(kind: str, pattern: str) -> str:
    """Rows (doc_id, kind, start, stop, match): lengths of pieces and matches, summed up."""
    p = _sql_text(pattern)
    return f"""
  SELECT doc_id, '{kind}' AS kind, match, stop - length(match) AS start, stop FROM (
    SELECT doc_id, match, sum(length(gap) + length(match)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
      SELECT doc_id, unnest(regexp_extract_all(text, {p})) AS match, unnest(regexp_split_to_array(text, {p})[:-2]) AS gap,
        generate_subscripts(regexp_extract_all(text, {p}), 1) AS i
      FROM documents WHERE regexp_matches(text, {p})))"""


_ALL = " UNION ALL ".join(_matches(k, p) for k, p in (secrets.BASE | secrets.WEAK).items())
_NEAR = f"p.doc_id = m.doc_id AND p.start <= m.stop + {secrets.SCOPE} AND p.stop >= m.start - {secrets.SCOPE}"
_IDENTIFIER = f"EXISTS (SELECT 1 FROM m AS p WHERE {_NEAR} AND p.kind IN ('access', 'ident'))"
_SECRET = f"EXISTS (SELECT 1 FROM m AS p WHERE {_NEAR} AND p.kind IN ('assign', 'hex', 'key40'))"
_COMPANY = f"doc_id IN (SELECT doc_id FROM documents WHERE regexp_matches(text, {_sql_text(secrets.BASE['access'])}) OR regexp_matches(text, {_sql_text(secrets.WEAK['ident'])}))"

OP8 = f"""
WITH a AS ({_ALL}), m AS (
  SELECT * FROM a WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(match, {_sql_text(secrets.BASE["assign"])}, 1)) >= 12
    WHEN 'access' THEN length(match) >= 18
    WHEN 'hex' THEN length(match) >= 16
    WHEN 'key40' THEN {_COMPANY} AND length(match) = 40 AND regexp_matches(match, '[0-9]') AND regexp_matches(match, '[a-z]') AND regexp_matches(match, '[A-Z]')
    ELSE {_COMPANY} END
), s AS (
  SELECT *, list_position({secrets.KINDS}, kind) AS rank FROM m
  WHERE kind IN ('assign', 'access', 'hex') OR (kind = 'ident' AND {_SECRET}) OR (kind = 'key40' AND {_IDENTIFIER})
    OR (kind = 'endpoint' AND {_IDENTIFIER} AND {_SECRET})
), g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank <= 3), '') AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents AS d LEFT JOIN g ON g.doc_id = d.doc_id
"""


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH b AS (
  SELECT item, words, row_number() OVER () AS r
  FROM (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({_LOW}, '{_LETTERS}') AS words, text FROM benchmark)
), w AS (
  SELECT item, r, size, o, words[o : o + size - 1] AS grams
  FROM (SELECT item, r, words, least(10, len(words)) AS size, unnest(generate_series(1, len(words) - least(10, len(words)) + 1)) AS o FROM b WHERE len(words) > 0)
), d AS (
  SELECT doc_id, regexp_extract_all({_LOW}, '{_LETTERS}') AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(generate_series(1, len(words))) AS i FROM d
), m AS (
  SELECT p.doc_id, p.i, w.size, w.item, w.r, w.o
  FROM (SELECT DISTINCT size FROM w) AS s JOIN p ON p.i + s.size - 1 <= len(p.words) JOIN w ON w.size = s.size AND w.grams = p.words[p.i : p.i + s.size - 1]
), h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(i, i + size - 1)) AS pos FROM m) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id
), g AS (
  SELECT doc_id, max(i) - min(i) + any_value(size) AS words
  FROM (SELECT doc_id, r, i, o, size, i - row_number() OVER (PARTITION BY doc_id, r, i - o ORDER BY i) AS run FROM m) GROUP BY doc_id, r, i - o, run
), l AS (
  SELECT doc_id, count(*) AS n_matches, max(words) AS longest FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, coalesce(l.n_matches, 0) AS n_matches, CAST(coalesce(l.longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_WORDS = f"regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+')"

OP10 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(1, len(words) - 4))) AS i FROM w WHERE len(words) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, ways.b FROM reach AS r JOIN ways ON ways.a = r.b
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_topk": OP1, "op2_mixing": OP2, "op6_decontamination": OP6, "op8_secret_scan": OP8, "op10_near_duplicates": OP10}
