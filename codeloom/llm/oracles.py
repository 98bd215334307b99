"""DuckDB SQL for the queries that SQL can express, over the whole tables."""

_OP2 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS g FROM starts),
firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM firsts, range(13) r(j) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
marked AS (SELECT words.doc_id, words.p, x, gone.p IS NOT NULL AS g FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p),
kept AS (
  SELECT doc_id, count(*) FILTER (g) AS n_removed, string_agg(x, ' ' ORDER BY p) FILTER (NOT g) AS t FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_OP4 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
sets AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
named AS (SELECT doc_id, dense_rank() OVER (ORDER BY g) AS g FROM sets),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM named x JOIN named y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n.n
"""

_OP5 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS h FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS position FROM s),
w AS (SELECT *, CAST([5, 2, 1][1 + (position - 1) % 3] AS DOUBLE) AS weight, 3 * source_size AS cap FROM p),
l AS (
  SELECT *, coalesce(sum(cap) OVER b, 0) AS capped,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT arg_min(level, cap / weight * 1e6 + position) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(cap AS DOUBLE), (SELECT level FROM v) * weight) AS target FROM w),
q AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS quota FROM t),
o AS (
  SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM d)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN size = 0 THEN 0 ELSE quota // source_size * size + greatest(0, least(size, quota % source_size - place)) END AS BIGINT) AS taken
FROM o JOIN q ON o.source IS NOT DISTINCT FROM q.source
"""

_OP8 = """
WITH usable AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
runs AS (SELECT doc_id, i, w[i:i + 4] AS g FROM windows),
twice AS (SELECT doc_id, i FROM runs QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) r(j) GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, text, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed
            OR word_chars < 2 * n_words OR word_chars > 30 * n_words
            OR 10 * n_symbols > n_words
            OR 10 * n_dup_lines > 3 * n_lines
            OR 10 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 6 * word_chars
            OR 10 * length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 5 * word_chars) AS kept
FROM judged
"""

_OP13 = """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::BIGINT AS score
  FROM usable a JOIN usable c ON a.vec_id % 100 = 0 AND (a.vec_id <> c.vec_id OR a.label <> c.label)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
  SELECT p.anchor_id, positive_id, s.vec_id AS negative_id, positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 5
"""

ORACLES: dict[str, str] = {"op2_repeated_phrases": _OP2, "op4_near_dedup": _OP4, "op5_mixing": _OP5, "op8_exact_topk": _OP8, "op10_quality_rules": _OP10,
                           "op13_hard_negatives": _OP13}
