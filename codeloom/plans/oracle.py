"""DuckDB SQL oracles, one per registered query key.

Token rule on both sides: lower, split on non letter/digit runs, drop empties.
"""

TOKENS = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"


def _tok(x: str) -> str:
    return TOKENS.format(x=x)


BM25_SCORES = f"""
d AS (SELECT doc_id, {_tok('text')} AS toks FROM documents),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM d),
q AS (SELECT item_id, term, count(*) AS qtf
      FROM (SELECT item_id, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT doc_id, dl, term, count(*) AS tf
      FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY doc_id, dl, term),
df AS (SELECT term, count(*) AS n FROM p GROUP BY term),
kw AS (SELECT q.item_id, p.doc_id,
              sum(q.qtf * ln(1 + (st.n_docs - df.n + 0.5) / (df.n + 0.5)) * p.tf * 2.2
                  / (p.tf + 1.2 * (1 - 0.75 + 0.75 * p.dl / st.avgdl))) AS kw_score
       FROM p JOIN df USING (term) JOIN q USING (term) CROSS JOIN st
       GROUP BY q.item_id, p.doc_id)
"""

ORACLES: dict[str, str] = {}

ORACLES["bm25_topk"] = f"""
WITH {BM25_SCORES},
r AS (SELECT item_id, doc_id, round(kw_score, 6) AS score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(kw_score, 6) DESC, doc_id) AS INTEGER) AS rank
      FROM kw)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES["bm25_stored_topk"] = ORACLES["bm25_topk"]

_TITLE_SCORES = f"""
td AS (SELECT doc_id, {_tok('string_split(text, chr(10))[1]')} AS toks FROM documents),
tst AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avgdl FROM td),
tp AS (SELECT doc_id, dl, term, count(*) AS tf
       FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM td)
       WHERE term IN (SELECT term FROM q) GROUP BY doc_id, dl, term),
tdf AS (SELECT term, count(*) AS n FROM tp GROUP BY term),
tkw AS (SELECT q.item_id, tp.doc_id,
               sum(q.qtf * ln(1 + (tst.n_docs - tdf.n + 0.5) / (tdf.n + 0.5)) * tp.tf * 2.2
                   / (tp.tf + 1.2 * (1 - 0.75 + 0.75 * tp.dl / tst.avgdl))) AS kw_score
        FROM tp JOIN tdf USING (term) JOIN q USING (term) CROSS JOIN tst
        GROUP BY q.item_id, tp.doc_id)
"""

ORACLES["bm25_fields_topk"] = f"""
WITH {BM25_SCORES}, {_TITLE_SCORES},
s AS (SELECT item_id, doc_id, round(2.0 * coalesce(tkw.kw_score, 0) + coalesce(kw.kw_score, 0), 6) AS score
      FROM kw FULL JOIN tkw USING (item_id, doc_id)),
r AS (SELECT item_id, doc_id, score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

_BOTH = f"""
bd AS (SELECT doc_id, {_tok('string_split(text, chr(10))[1]')} AS title, {_tok('text')} AS body FROM documents),
bst AS (SELECT count(*) AS n_docs, avg(len(title)) AS title_avg, avg(len(body)) AS body_avg FROM bd),
bt AS (SELECT doc_id, unnest(title) AS term, 1 AS in_title, 0 AS in_body FROM bd
       UNION ALL SELECT doc_id, unnest(body), 0, 1 FROM bd),
bp AS (SELECT doc_id, term, sum(in_title) AS title_tf, sum(in_body) AS body_tf FROM bt
       WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
bdf AS (SELECT term, count(*) AS n FROM bp GROUP BY term),
bx AS (SELECT bp.doc_id, term,
              2.0 * title_tf / (1 - 0.75 + 0.75 * len(title) / title_avg) + body_tf / (1 - 0.75 + 0.75 * len(body) / body_avg) AS x
       FROM bp JOIN bd USING (doc_id) CROSS JOIN bst),
bkw AS (SELECT q.item_id, bx.doc_id, sum(q.qtf * ln(1 + (bst.n_docs - bdf.n + 0.5) / (bdf.n + 0.5)) * x * 2.2 / (x + 1.2)) AS kw_score
        FROM bx JOIN bdf USING (term) JOIN q USING (term) CROSS JOIN bst GROUP BY q.item_id, bx.doc_id)
"""

ORACLES["bm25f_topk"] = f"""
WITH {BM25_SCORES}, {_BOTH},
r AS (SELECT item_id, doc_id, round(kw_score, 6) AS score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(kw_score, 6) DESC, doc_id) AS INTEGER) AS rank
      FROM bkw)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

VECTORS = """
qv AS (SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
       WHERE vec_id IN (SELECT item_id FROM benchmark)),
dv AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
       WHERE vec_id IN (SELECT doc_id FROM documents)),
vr AS (SELECT qv.item_id, dv.doc_id, round(list_cosine_similarity(qv.e, dv.e), 6) AS vec_score FROM qv, dv)
"""

ORACLES["vector_topk"] = f"""
WITH {VECTORS},
r AS (SELECT item_id, doc_id, vec_score AS score,
             CAST(row_number() OVER (PARTITION BY item_id ORDER BY vec_score DESC, doc_id) AS INTEGER) AS rank
      FROM vr)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES["vector_topk_indexed"] = ORACLES["vector_topk"]

KW_SCALED = """
kwr AS (SELECT item_id, doc_id, round(kw_score, 6) AS kw_score FROM kw),
ks AS (SELECT *, min(kw_score) OVER (PARTITION BY item_id) AS kw_min,
                 max(kw_score) OVER (PARTITION BY item_id) AS kw_max FROM kwr)
"""

ORACLES["hybrid_topk"] = f"""
WITH {BM25_SCORES}, {KW_SCALED}, {VECTORS},
kr AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY kw_score DESC, doc_id) AS kw_rank FROM kwr),
vp AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY vec_score DESC, doc_id) AS vec_rank FROM vr),
vs AS (SELECT *, min(vec_score) OVER (PARTITION BY item_id) AS vec_min,
                 max(vec_score) OVER (PARTITION BY item_id) AS vec_max FROM vr),
j AS (SELECT coalesce(ks.item_id, vs.item_id) AS item_id, coalesce(ks.doc_id, vs.doc_id) AS doc_id,
             ks.kw_score, vs.vec_score,
             CASE WHEN ks.kw_score IS NULL THEN 0.0 WHEN ks.kw_max = ks.kw_min THEN 1.0
                  ELSE (ks.kw_score - ks.kw_min) / (ks.kw_max - ks.kw_min) END AS ksc,
             CASE WHEN vs.vec_score IS NULL THEN 0.0 WHEN vs.vec_max = vs.vec_min THEN 1.0
                  ELSE (vs.vec_score - vs.vec_min) / (vs.vec_max - vs.vec_min) END AS vsc
      FROM ks FULL OUTER JOIN vs ON ks.item_id = vs.item_id AND ks.doc_id = vs.doc_id),
f AS (SELECT *, round(0.7 * vsc + 0.3 * ksc, 6) AS score FROM j),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f)
SELECT item_id, rank, doc_id, score, kw_score,
       CASE WHEN kw_score IS NOT NULL THEN round(ksc, 6) END AS kw_scaled,
       vec_score,
       CASE WHEN vec_score IS NOT NULL THEN round(vsc, 6) END AS vec_scaled,
       kw_rank, vec_rank
FROM r LEFT JOIN kr USING (item_id, doc_id) LEFT JOIN vp USING (item_id, doc_id) WHERE rank <= 10
"""

ORACLES["sink_batches"] = """
SELECT 'rows' AS kind, source AS name, count(*) AS n FROM documents WHERE length(text) >= 30 GROUP BY source
UNION ALL
SELECT 'failed', 'batch-' || CAST(doc_id % 3 AS VARCHAR), count(*) FILTER (WHERE coalesce(length(text) < 30, TRUE)) FROM documents GROUP BY doc_id % 3
"""

ORACLES["issue_states"] = """
SELECT item_id AS issue_id, CASE WHEN length(text) % 3 = 1 THEN 'failed' ELSE 'done' END AS after_first, 'done' AS after_second,
       CAST(CASE WHEN length(text) % 3 = 1 THEN 1 ELSE 0 END AS BIGINT) AS failures, CAST(length(text) AS VARCHAR) AS answer,
       CASE WHEN length(text) % 3 = 1 THEN 'second' ELSE 'first' END AS run
FROM benchmark
"""

ORACLES["hybrid_typed_hits"] = f"""
WITH {BM25_SCORES}, {KW_SCALED},
f AS (SELECT item_id, doc_id,
             round(CASE WHEN kw_max = kw_min THEN 1.0 ELSE (kw_score - kw_min) / (kw_max - kw_min) END, 6) AS score
      FROM ks),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f),
h AS (SELECT r.item_id, r.rank, d.lang || '/doc_' || CAST(d.doc_id AS VARCHAR) || '.txt' AS file,
             'doc_' || CAST(d.doc_id AS VARCHAR) AS function_type, d.source AS type, d.text, r.score
      FROM r JOIN documents d USING (doc_id)
      WHERE r.rank <= 10
        AND d.source IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9'))
SELECT b.item_id, h.rank, h.file, h.function_type, h.type, h.text, h.score
FROM benchmark b LEFT JOIN h ON b.item_id = h.item_id
"""

# Python str.splitlines() boundaries and str.strip() whitespace, in RE2 syntax.
LINES_RE = "'\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]'"
WS = "[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _comments(x: str) -> str:
    return (f"list_filter(list_transform(list_transform(regexp_split_to_array({x}, {LINES_RE}), "
            f"lambda l: {_strip('l')}), "
            "lambda l: CASE WHEN strpos(l, '#') > 0 THEN substr(l, strpos(l, '#')) END), "
            "lambda c: c IS NOT NULL AND length(c) > 2)")


ORACLES["issue_slice"] = """
SELECT doc_id AS issue_idx, doc_id + 1 AS serial_no, source AS repo, lang AS base_commit,
       text AS problem_statement
FROM documents WHERE doc_id BETWEEN 11 AND 20
"""

ORACLES["snippet_count"] = """
SELECT lang AS snapshot_id, source AS type, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)
"""

ORACLES["inline_comments"] = f"""
WITH l AS (SELECT doc_id, {_comments('text')} AS cs FROM documents)
SELECT doc_id, CAST(unnest(generate_series(0, len(cs) - 1)) AS INTEGER) AS i, unnest(cs) AS comment
FROM l WHERE len(cs) > 0
"""

USER_UPDATES = """
ev AS (SELECT user_id, ts, event_id, event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents,
              json_extract_string(props, '$.k') AS k FROM events),
u AS (SELECT CAST(user_id AS VARCHAR) AS id, ts, event_id, event_type AS prop, cents AS value FROM ev
      UNION ALL SELECT CAST(user_id AS VARCHAR), ts, event_id, 'last_type', event_type FROM ev
      UNION ALL SELECT CAST(user_id AS VARCHAR), ts, event_id, 'k', CASE WHEN event_type <> 'error' THEN k END FROM ev)
"""

ORACLES["node_upsert"] = f"""
WITH {USER_UPDATES},
r AS (SELECT *, row_number() OVER (PARTITION BY id, prop ORDER BY ts DESC, event_id DESC) AS rn FROM u)
SELECT 'User' AS label, id, prop, value FROM r WHERE rn = 1 AND value IS NOT NULL
"""

ORACLES["neighbourhood_hub"] = """
WITH d AS (SELECT DISTINCT l_returnflag AS pid, 'Order:' || CAST(l_orderkey AS VARCHAR) AS neighbour FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY neighbour) - 1 AS i FROM d)
SELECT pid, 'MARKS' AS rel, CAST(i // 256 AS INTEGER) AS page, count(*) OVER (PARTITION BY pid, i // 256) AS page_size,
       CAST(i % 256 AS INTEGER) AS pos, neighbour FROM r
"""

ORACLES["node_upsert_state"] = f"""
WITH {USER_UPDATES},
r AS (SELECT *, row_number() OVER (PARTITION BY event_id % 2, id, prop ORDER BY ts DESC, event_id DESC) AS rn FROM u)
SELECT CASE event_id % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS snapshot_id, 'User' AS label, id, prop, value
FROM r WHERE rn = 1 AND value IS NOT NULL
"""

ORACLES["edge_upsert"] = """
WITH n AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE event_type = 'signup'),
e AS (SELECT CAST(user_id AS VARCHAR) AS src_id, json_extract_string(props, '$.k') AS dst_id, ts, event_id,
             event_type, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS cents FROM events),
ek AS (SELECT * FROM e WHERE src_id IN (SELECT id FROM n) AND dst_id IN (SELECT id FROM n)),
u AS (SELECT src_id, dst_id, ts, event_id, 'type' AS prop, event_type AS value FROM ek
      UNION ALL SELECT src_id, dst_id, ts, event_id, 'cents', cents FROM ek),
r AS (SELECT *, row_number() OVER (PARTITION BY src_id, dst_id, prop ORDER BY ts DESC, event_id DESC) AS rn FROM u)
SELECT 'User' AS src_label, src_id, 'REFERS' AS rel, 'User' AS dst_label, dst_id, prop, value
FROM r WHERE rn = 1 AND value IS NOT NULL
"""

ORACLES["detach_delete"] = """
WITH nodes AS (SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS id FROM customer
               UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR) FROM orders),
edges AS (SELECT 'Customer' AS src_label, CAST(o_custkey AS VARCHAR) AS src_id, 'PLACED' AS rel,
                 'Order' AS dst_label, CAST(o_orderkey AS VARCHAR) AS dst_id FROM orders),
doomed AS (SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'AUTOMOBILE')
SELECT 'node' AS kind, label, id, CAST(NULL AS VARCHAR) AS rel, CAST(NULL AS VARCHAR) AS dst_label,
       CAST(NULL AS VARCHAR) AS dst_id
FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.label = n.label AND d.id = n.id)
UNION ALL
SELECT 'edge', src_label, src_id, rel, dst_label, dst_id FROM edges e
WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.label = e.src_label AND d.id = e.src_id)
  AND NOT EXISTS (SELECT 1 FROM doomed d WHERE d.label = e.dst_label AND d.id = e.dst_id)
"""

ORACLES["neighbourhood"] = """
WITH nodes AS (SELECT 'Customer' AS label, CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer
               UNION ALL SELECT 'Order', CAST(o_orderkey AS VARCHAR), 'order_' || CAST(o_orderkey AS VARCHAR) FROM orders
               UNION ALL SELECT 'Part', CAST(p_partkey AS VARCHAR), p_name FROM part
               UNION ALL SELECT 'Supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier),
edges AS (SELECT DISTINCT * FROM (
          SELECT 'Customer' AS src_label, CAST(o_custkey AS VARCHAR) AS src_id, 'PLACED' AS rel,
                 'Order' AS dst_label, CAST(o_orderkey AS VARCHAR) AS dst_id FROM orders
          UNION ALL SELECT 'Order', CAST(l_orderkey AS VARCHAR), 'CONTAINS', 'Part', CAST(l_partkey AS VARCHAR) FROM lineitem
          UNION ALL SELECT 'Supplier', CAST(l_suppkey AS VARCHAR), 'SHIPPED', 'Order', CAST(l_orderkey AS VARCHAR) FROM lineitem)),
seeds AS (SELECT DISTINCT o_custkey AS issue_id, 'order_' || CAST(o_orderkey AS VARCHAR) AS name FROM orders),
prim AS (SELECT s.issue_id, n.id AS pid, n.name AS pname FROM seeds s JOIN nodes n ON n.label = 'Order' AND n.name = s.name),
rin AS (SELECT e.rel, o.label AS olabel, e.dst_id AS pid, o.name AS v FROM edges e
        JOIN nodes o ON o.label = e.src_label AND o.id = e.src_id WHERE e.dst_label = 'Order'),
rout AS (SELECT e.rel, o.label AS olabel, e.src_id AS pid, o.name AS v FROM edges e
         JOIN nodes o ON o.label = e.dst_label AND o.id = e.dst_id WHERE e.src_label = 'Order'),
f AS (SELECT pid, list_sort(list_distinct(list(v))) AS vals FROM rin WHERE rel = 'PLACED' AND olabel = 'Customer' GROUP BY pid),
c AS (SELECT pid, list_sort(list_distinct(list(v))) AS vals FROM rin WHERE rel = 'SHIPPED' AND olabel = 'Supplier' GROUP BY pid),
k AS (SELECT pid, list_sort(list_distinct(list(v))) AS vals FROM rout WHERE rel = 'CONTAINS' AND olabel = 'Part' GROUP BY pid),
nb AS (SELECT pid, list_sort(list_distinct(list(nb))) AS vals FROM (
         SELECT src_id AS pid, dst_label || ':' || dst_id AS nb FROM edges WHERE src_label = 'Order'
         UNION ALL SELECT dst_id, src_label || ':' || src_id FROM edges WHERE dst_label = 'Order') GROUP BY pid),
res AS (SELECT prim.issue_id, prim.pid AS id, prim.pname AS name, f.vals AS files, c.vals AS classes,
               k.vals AS called, nb.vals AS neighbours
        FROM prim LEFT JOIN f USING (pid) LEFT JOIN c USING (pid) LEFT JOIN k USING (pid) LEFT JOIN nb USING (pid))
SELECT cu.c_custkey AS issue_id, res.id, res.name,
       coalesce(res.files, CAST([] AS VARCHAR[])) AS files, coalesce(res.classes, CAST([] AS VARCHAR[])) AS classes,
       coalesce(res.called, CAST([] AS VARCHAR[])) AS called, coalesce(res.neighbours, CAST([] AS VARCHAR[])) AS neighbours
FROM customer cu LEFT JOIN res ON cu.c_custkey = res.issue_id
"""

# ---- candidate extraction and scoring over F2 (expected values by concatenation, not regex)
from . import replies_fixture as _F2  # noqa: E402


def _d(x) -> str:
    return f"CAST({x} AS DOUBLE)"


_CAND = f"""
{_F2.SQL_TURNS},
ct AS (SELECT conv_id, turn, n, CAST((conv_id + turn) % 8 AS INTEGER) AS t, conv_id % 11 = 0 AS nodiff,
              {_F2.sql_func('conv_id', 'turn')} AS tmpl, {_F2.sql_diff_body('conv_id', 'turn')} AS body
       FROM aturn)
"""

ORACLES["candidates"] = f"""
WITH {_CAND}
SELECT conv_id, n AS patch_id,
       CASE WHEN nodiff THEN '' ELSE '# Candidate Patch ' || CAST(n AS VARCHAR) || '\n# File: f_' || CAST(conv_id AS VARCHAR)
            || '.py' || CASE WHEN tmpl = '' THEN '' ELSE '\n\n' || tmpl END END AS func,
       CASE WHEN nodiff THEN '' ELSE '# Candidate Patch ' || CAST(n AS VARCHAR) || ' (Unified Diff)\n\n' || body END AS diff
FROM ct WHERE conv_id % 10 <> 0
"""

ORACLES["candidates_strict"] = f"""
WITH {_CAND}
SELECT conv_id, n AS patch_id, tmpl AS func, body AS diff FROM ct WHERE NOT nodiff
"""

_SCORES = f"""
{_CAND},
sc AS (SELECT conv_id, n AS patch_id, nodiff,
              CASE WHEN nodiff THEN '' ELSE '# Candidate Patch ' || CAST(n AS VARCHAR) || '\n# File: f_' || CAST(conv_id AS VARCHAR)
                   || '.py' || CASE WHEN tmpl = '' THEN '' ELSE '\n\n' || tmpl END END AS func,
              CASE WHEN nodiff THEN {_d(1.0)} ELSE {_d(1.0)} - least({_d('turn + conv_id % 40')} / {_d(30.0)}, {_d(1.0)}) END AS patch_size,
              CASE WHEN nodiff THEN {_d(1.0)} ELSE {_d(_F2.sql_template_scores('t', 0))} END AS syntax,
              {_d(0.8)} AS style,
              CASE WHEN nodiff THEN {_d(1.0)} ELSE {_d(_F2.sql_template_scores('t', 1))} END AS exception,
              CASE WHEN nodiff THEN {_d(1.0)} ELSE {_d(_F2.sql_template_scores('t', 2))} END AS docstring,
              CASE WHEN nodiff THEN {_d(1.0)} ELSE {_d(_F2.sql_template_scores('t', 3))} END AS variable,
              CASE WHEN nodiff THEN {_d(0.5)} ELSE {_d(_F2.sql_template_scores('t', 4))} END AS pattern,
              CASE WHEN conv_id % 7 = 0 THEN {_d(0.5)} ELSE {_d('conv_id % 10')} / {_d(10.0)} END AS llm
       FROM ct WHERE conv_id % 10 <> 0),
st AS (SELECT *, round(patch_size * {_d(0.15)} + syntax * {_d(0.15)} + style * {_d(0.1)} + exception * {_d(0.1)}
                       + docstring * {_d(0.1)} + variable * {_d(0.1)} + pattern * {_d(0.1)} + llm * {_d(0.2)}, 4) AS total
       FROM sc)
"""

ORACLES["patch_scores"] = f"""
WITH {_SCORES}
SELECT conv_id, patch_id, patch_size, syntax, style, exception, docstring, variable, pattern, llm, total FROM st
"""

ORACLES["best_patch"] = f"""
WITH {_SCORES},
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY total DESC, patch_id) AS rn FROM st)
      WHERE rn = 1)
SELECT c.conv_id,
       CASE WHEN c.conv_id % 10 = 0 THEN 'unknown_file.py' ELSE 'f_' || CAST(c.conv_id AS VARCHAR) || '.py' END AS file_name,
       CASE WHEN c.conv_id % 10 = 0 THEN 'unknown_function' ELSE 'fn_' || CAST(c.conv_id AS VARCHAR) END AS function_name,
       b.patch_id AS best_patch_id, b.total AS best_total, b.func AS best_func
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN b USING (conv_id)
"""

ORACLES["extraction_stats"] = f"""
WITH {_F2.sql_replies()},
k AS (SELECT conv_id, count(*) AS n FROM aturn WHERE conv_id % 10 <> 0 GROUP BY conv_id)
SELECT r.conv_id, CAST(coalesce(k.n, 0) AS INTEGER) AS n_blocks, CAST(coalesce(k.n, 0) AS BIGINT) AS n_scored,
       CASE WHEN coalesce(k.n, 0) = 0 THEN substr(r.reply, 1, 400) END AS quarantine
FROM rep r LEFT JOIN k USING (conv_id)
"""

from .oracle_code import O as _CODE  # noqa: E402

ORACLES.update(_CODE)

ORACLES["commit_graph"] = """
WITH ev AS (SELECT event_id, ts, user_id, event_type, value, props,
                   CASE WHEN event_id % 10 <> 0 THEN event_id - 1 - event_id % 3 END AS prev_id FROM events),
c AS (SELECT CAST(event_id AS VARCHAR) AS hexsha, CAST(user_id AS VARCHAR) AS author, event_type AS message,
             CASE WHEN epoch_us(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                  ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS tstamp,
             CASE WHEN prev_id IS NULL THEN NULL WHEN event_id % 25 = 0 THEN 'missing_' || CAST(event_id AS VARCHAR)
                  ELSE CAST(prev_id AS VARCHAR) END AS parent,
             'f_' || json_extract_string(props, '$.k') || '.py' AS path,
             CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'A' ELSE 'M' END AS change_type,
             CASE WHEN event_type = 'signup' THEN '' ELSE 'f_' || json_extract_string(props, '$.k') || '.py' END AS a_path,
             CASE WHEN event_type = 'error' AND event_id % 40 <> 0 THEN ''
                  ELSE 'f_' || json_extract_string(props, '$.k') || '.py' END AS b_path,
             '@@ ' || event_type || ' ' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS diff_text
      FROM ev),
commit_nodes AS (SELECT hexsha AS id, p.prop, CASE p.prop WHEN 'hexsha' THEN hexsha WHEN 'author' THEN author
                        WHEN 'message' THEN message ELSE tstamp END AS value
                 FROM c, (SELECT unnest(['hexsha', 'author', 'message', 'timestamp']) AS prop) p),
stub_nodes AS (SELECT DISTINCT parent AS id, 'hexsha' AS prop, parent AS value FROM c
               WHERE parent IS NOT NULL AND parent NOT IN (SELECT hexsha FROM c)),
mods AS (SELECT hexsha, b_path AS fpath, 'MODIFIES' AS rel, change_type, diff_text FROM c WHERE b_path <> ''),
dels AS (SELECT hexsha, a_path AS fpath, 'DELETES' AS rel, change_type, diff_text FROM c
         WHERE b_path = '' AND a_path <> '' AND change_type = 'D'),
fe AS (SELECT * FROM mods UNION ALL SELECT * FROM dels),
files AS (SELECT DISTINCT fpath FROM fe)
SELECT 'node' AS kind, 'Commit' AS src_label, id AS src_id, CAST(NULL AS VARCHAR) AS rel,
       CAST(NULL AS VARCHAR) AS dst_label, CAST(NULL AS VARCHAR) AS dst_id, prop, value
FROM (SELECT * FROM commit_nodes UNION ALL SELECT * FROM stub_nodes)
UNION ALL SELECT 'node', 'File', fpath, NULL, NULL, NULL, 'path', fpath FROM files
UNION ALL SELECT 'node', 'File', fpath, NULL, NULL, NULL, 'name', fpath FROM files
UNION ALL SELECT 'edge', 'Commit', hexsha, 'PARENT_OF', 'Commit', parent, NULL, NULL FROM c WHERE parent IS NOT NULL
UNION ALL SELECT 'edge', 'Commit', hexsha, rel, 'File', fpath, 'change_type', change_type FROM fe
UNION ALL SELECT 'edge', 'Commit', hexsha, rel, 'File', fpath, 'diff_text', diff_text FROM fe
"""

# ---- prompts and parsed model replies
from ..operators.predict import STUB_CYPHER as _CYPHER  # noqa: E402
from ..operators.prompts import ANALYSIS_TEMPLATE as _P1, PATCH_TEMPLATE as _P3, render_sql as _render  # noqa: E402

ORACLES["prompts"] = f"""
WITH th AS ({ORACLES["hybrid_typed_hits"]}),
hl AS (SELECT item_id,
              string_agg('- ' || CAST(rank AS VARCHAR) || '. ' || file || ' :: ' || function_type || ' [' || type
                         || '] score=' || printf('%.6f', score) || chr(10) || text, chr(10) ORDER BY rank) AS hits
       FROM th WHERE rank IS NOT NULL GROUP BY item_id)
SELECT b.item_id, {_render(_P1, issue='b.text')} AS analysis_prompt,
       {_render(_P3, issue='b.text', hits="coalesce(hl.hits, '(none)')", graph="'(none)'")} AS patch_prompt
FROM benchmark b LEFT JOIN hl ON b.item_id = hl.item_id
"""

ORACLES["parsed_queries"] = f"""
WITH k AS (SELECT item_id, array_to_string(list_sort(list_distinct({_tok('text')})), ' ') AS kw FROM benchmark)
SELECT item_id, '### Analysis Result' || chr(10) || '**Keywords/Concepts:** ' || kw || chr(10) || '###' AS analysis,
       kw AS vector_query, {"'" + _CYPHER.replace("'", "''") + "'"} AS cypher_query
FROM k
"""
