"""DuckDB oracles for the code-corpus queries: expected symbols follow from the F1
template table (source_fixture.LINES / SYMBOLS), never from parsing."""

from . import source_fixture as F1

BASE = f"""
{F1.sql_lines()},
{F1.sql_symbols()},
syx AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY def_ord) - 1 AS INTEGER) AS ord FROM symx),
fn AS (SELECT * FROM syx WHERE kind = 'function'),
cl AS (SELECT * FROM syx WHERE kind = 'class'),
okf AS (SELECT k, s, pname, path FROM fp WHERE NOT cut),
calls AS (SELECT f.path, f.k, f.name AS caller, c.pos, c.callee FROM fn f,
          LATERAL (SELECT CAST(unnest(generate_series(0, len(l) - 1)) AS INTEGER) AS pos, unnest(l) AS callee
                   FROM (SELECT CASE f.tag
                     WHEN 'price' THEN ['Part' || CAST(f.k AS VARCHAR) || '.check', 'helper_' || CAST(f.k + 1 AS VARCHAR), 'os.getpid']
                     WHEN 'helper' THEN ['Part' || CAST(f.k AS VARCHAR) || '.check']
                     ELSE CAST([] AS VARCHAR[]) END AS l)) c),
symtab AS (SELECT name, symbol_id, kind FROM (
             SELECT name, path || '::' || name AS symbol_id, CASE WHEN kind = 'class' THEN 1 ELSE 0 END AS kind,
                    row_number() OVER (PARTITION BY name ORDER BY path DESC, CASE WHEN kind = 'class' THEN 1 ELSE 0 END DESC,
                                       ord DESC) AS rn
             FROM syx) WHERE rn = 1),
fnodes AS (SELECT DISTINCT path || '::' || name AS id FROM fn),
cnodes AS (SELECT DISTINCT path || '::' || name AS id FROM cl)
"""

O: dict[str, str] = {}

O["code_functions"] = f"""
WITH {BASE}
SELECT path, name, lineno, col_offset, end_lineno, end_col_offset, code_snippet, is_static, ord AS def_ord FROM fn
"""

O["code_snapshots"] = f"""
WITH {BASE},
nf AS (SELECT fp.k, fp.path, CASE WHEN fp.cut THEN NULL ELSE CAST(coalesce(c.n, 0) AS INTEGER) END AS n
       FROM fp LEFT JOIN (SELECT path, count(*) AS n FROM fn GROUP BY path) c USING (path))
SELECT '{F1.SNAPSHOT}' AS snapshot_id, path, n AS n_functions, TRUE AS parsed_now FROM nf
UNION ALL
SELECT 'later', path, CAST(n + CASE WHEN k % 10 = {F1.CHANGED} THEN 1 ELSE 0 END AS INTEGER), k % 10 = {F1.CHANGED} FROM nf
"""

O["neighbourhood_filtered"] = f"""
WITH {BASE}
SELECT DISTINCT b.item_id AS issue_id, 'Function' AS label, f.path || '::' || f.name AS id
FROM benchmark b JOIN fn f ON b.item_id % 2 = 0 AND f.is_static AND split_part(f.path, '/', 1) = 'pkg_' || CAST(b.item_id % 50 + 1 AS VARCHAR)
UNION ALL
SELECT DISTINCT b.item_id, 'Class', c.path || '::' || c.name FROM benchmark b JOIN cl c ON b.item_id % 2 <> 0 AND c.name = 'Part' || CAST(b.item_id AS VARCHAR)
"""

O["pattern_findings"] = f"""
WITH {BASE}
SELECT DISTINCT 'Class' AS src_label, path || '::' || name AS src_id, 'Composite' AS pattern, 'Node' AS role FROM cl WHERE k % 10 = 0
UNION ALL
SELECT DISTINCT 'Function', path || '::' || name, 'Factory', 'Participant' FROM fn WHERE k % 10 = 0 AND name = 'helper_' || CAST(k AS VARCHAR)
"""

O["code_classes"] = f"""
WITH {BASE}
SELECT path, name, lineno, col_offset, end_lineno, end_col_offset, code_snippet, ord AS def_ord FROM cl
"""

O["code_bases_attrs"] = f"""
WITH {BASE}
SELECT path, name AS class, 'base' AS kind, CAST(0 AS INTEGER) AS pos, 'Part' || CAST(k // 2 AS VARCHAR) AS value
FROM cl WHERE k <> 0
UNION ALL
SELECT path, name, 'attribute', CAST(0 AS INTEGER), 'size' FROM cl
"""

O["code_imports_aliases"] = f"""
WITH {BASE}
SELECT path, 'import' AS kind, CAST(p.pos AS INTEGER) AS pos, CAST(NULL AS VARCHAR) AS alias,
       CASE WHEN p.pos = 0 THEN 'os' ELSE 'pkg_' || CAST(s AS VARCHAR) END AS module
FROM okf, (SELECT unnest([0, 1, 2]) AS pos) p
UNION ALL
SELECT path, 'alias', CAST(NULL AS INTEGER), 'P', 'pkg_' || CAST(s AS VARCHAR) FROM okf
"""

O["code_calls"] = f"""
WITH {BASE}
SELECT path, caller, pos, callee FROM calls
"""

O["parse_errors"] = """
SELECT 'pkg_' || CAST(p_size AS VARCHAR) || '/part_' || CAST(p_partkey AS VARCHAR) || '.py' AS path, TRUE AS syntax_error
FROM part WHERE p_partkey % 50 = 0
"""

O["symbol_table"] = f"""
WITH {BASE}
SELECT name, symbol_id, CAST(kind AS INTEGER) AS kind FROM symtab
"""

O["design_patterns"] = f"""
WITH {BASE}
SELECT path || '::' || name AS class_id, 'Singleton' AS pattern, 'Singleton' AS role FROM cl WHERE k % 20 = 0
"""

O["snippets"] = f"""
WITH {BASE}
SELECT path || '::func::' || name AS snippet_id, 'function_code' AS type, path AS file, name, lineno, code_snippet AS text
FROM fn
UNION ALL SELECT path || '::class::' || name, 'class_code', path, name, lineno, code_snippet FROM cl
UNION ALL SELECT path || '::func::' || name || '::docstring', 'docstring', path, name, CAST(NULL AS INTEGER), 'check doc'
FROM fn WHERE tag = 'check'
UNION ALL SELECT path || '::func::' || name || '::comment::0', 'comment', path, name, CAST(NULL AS INTEGER),
                 '# price of ' || (SELECT pname FROM okf WHERE okf.k = fn.k) FROM fn WHERE tag = 'price'
UNION ALL SELECT path || '::class::' || name || '::comment::0', 'comment', path, name, CAST(NULL AS INTEGER),
                 '# price of ' || (SELECT pname FROM okf WHERE okf.k = cl.k) FROM cl
UNION ALL SELECT f.path || '::func::' || f.caller || '::usage', 'usage_context', f.path, f.caller, CAST(NULL AS INTEGER),
                 f.caller || ' calls: ' || string_agg(f.callee, ', ' ORDER BY f.pos)
FROM calls f GROUP BY f.path, f.caller
"""

O["graph_nodes"] = f"""
WITH {BASE},
fnode AS (SELECT path || '::' || name AS id, name, lineno, end_lineno, path, code_snippet, is_static FROM fn),
cnode AS (SELECT path || '::' || name AS id, name, lineno, end_lineno, path, code_snippet, k FROM cl)
SELECT 'File' AS label, path AS id, 'path' AS prop, path AS value FROM okf
UNION ALL SELECT 'File', path, 'name', 'part_' || CAST(k AS VARCHAR) || '.py' FROM okf
UNION ALL SELECT 'Function', id, p.prop, CASE p.prop WHEN 'id' THEN id WHEN 'name' THEN name
          WHEN 'lineno' THEN CAST(lineno AS VARCHAR) WHEN 'end_lineno' THEN CAST(end_lineno AS VARCHAR)
          WHEN 'file_path' THEN path WHEN 'code_snippet' THEN code_snippet ELSE CAST(is_static AS VARCHAR) END
  FROM fnode, (SELECT unnest(['id', 'name', 'lineno', 'end_lineno', 'file_path', 'code_snippet', 'is_static']) AS prop) p
UNION ALL SELECT 'Class', id, p.prop, CASE p.prop WHEN 'id' THEN id WHEN 'name' THEN name
          WHEN 'lineno' THEN CAST(lineno AS VARCHAR) WHEN 'end_lineno' THEN CAST(end_lineno AS VARCHAR)
          WHEN 'file_path' THEN path ELSE code_snippet END
  FROM cnode, (SELECT unnest(['id', 'name', 'lineno', 'end_lineno', 'file_path', 'code_snippet']) AS prop) p
UNION ALL SELECT 'Attribute', id || '::size', p.prop, CASE p.prop WHEN 'id' THEN id || '::size' WHEN 'name' THEN 'size'
          WHEN 'class_id' THEN id ELSE path END
  FROM cnode, (SELECT unnest(['id', 'name', 'class_id', 'file_path']) AS prop) p
UNION ALL SELECT DISTINCT 'Package', m, 'name', m
  FROM (SELECT unnest(['os', 'pkg_' || CAST(s AS VARCHAR)]) AS m FROM okf)
UNION ALL SELECT DISTINCT 'DesignPattern', 'Singleton', 'name', 'Singleton' FROM cl WHERE k % 20 = 0
"""

O["graph_contains"] = f"""
WITH {BASE}
SELECT DISTINCT 'File' AS src_label, path AS src_id, 'CONTAINS_FUNCTION' AS rel, 'Function' AS dst_label,
       path || '::' || name AS dst_id FROM fn
UNION ALL SELECT 'File', path, 'CONTAINS_CLASS', 'Class', path || '::' || name FROM cl
UNION ALL SELECT 'Class', path || '::' || name, 'HAS_ATTRIBUTE', 'Attribute', path || '::' || name || '::size' FROM cl
"""

O["graph_inherits_overrides"] = f"""
WITH {BASE},
inh AS (SELECT cl.path, cl.name, cl.k, 'Part' || CAST(cl.k // 2 AS VARCHAR) AS base, t.symbol_id AS base_id
        FROM cl JOIN symtab t ON t.name = 'Part' || CAST(cl.k // 2 AS VARCHAR) WHERE cl.k <> 0)
SELECT DISTINCT 'Class' AS src_label, path || '::' || name AS src_id, 'INHERITS' AS rel, 'Class' AS dst_label, base_id AS dst_id
FROM inh WHERE base_id IN (SELECT id FROM cnodes)
UNION ALL
SELECT DISTINCT 'Function', f.path || '::' || f.name, 'OVERRIDES', 'Function', t.symbol_id
FROM inh JOIN fn f ON f.path = inh.path AND f.name LIKE inh.name || '.%'
JOIN symtab t ON t.name = inh.base || '.' || split_part(f.name, '.', 2)
WHERE t.symbol_id IN (SELECT id FROM fnodes)
"""

_CALL_EDGES = """
ce AS (SELECT DISTINCT c.path, 'Function' AS src_label, c.path || '::' || c.caller AS src_id, 'CALLS' AS rel,
              'Function' AS dst_label, t.symbol_id AS dst_id
       FROM calls c JOIN symtab t ON t.name = c.callee
       WHERE t.symbol_id IN (SELECT id FROM fnodes))
"""

O["graph_calls"] = f"""
WITH {BASE}, {_CALL_EDGES}
SELECT src_label, src_id, rel, dst_label, dst_id FROM ce
"""

O["graph_calls_as_coded"] = f"""
WITH {BASE}, {_CALL_EDGES}
SELECT src_label, src_id, rel, dst_label, dst_id FROM ce WHERE split_part(dst_id, '::', 1) <= path
"""

O["graph_imports"] = f"""
WITH {BASE}
SELECT DISTINCT 'File' AS src_label, path AS src_id, 'IMPORTS' AS rel, 'Package' AS dst_label, m AS dst_id
FROM (SELECT path, unnest(['os', 'pkg_' || CAST(s AS VARCHAR)]) AS m FROM okf)
"""

O["neighbourhood_class"] = f"""
WITH {BASE}, {_CALL_EDGES},
seeds AS (SELECT p_partkey AS issue_id, 'helper_' || CAST(p_partkey AS VARCHAR) AS name FROM part
          UNION ALL SELECT p_partkey, 'Part' || CAST(p_partkey AS VARCHAR) || '.price' FROM part),
fnn AS (SELECT DISTINCT path || '::' || name AS id, name, path FROM fn),
prim AS (SELECT s.issue_id, f.id, f.name, f.path FROM seeds s JOIN fnn f ON f.name = s.name),
called AS (SELECT ce.src_id AS id, list_sort(list_distinct(list(f.name))) AS vals
           FROM ce JOIN fnn f ON f.id = ce.dst_id GROUP BY ce.src_id),
res AS (SELECT p.issue_id, p.id, p.name, [p.path] AS files, CAST([] AS VARCHAR[]) AS classes,
               coalesce(c.vals, CAST([] AS VARCHAR[])) AS called,
               CASE WHEN p.name LIKE '%.%' THEN p.path || '::' || split_part(p.name, '.', 1) END AS owner_class
        FROM prim p LEFT JOIN called c USING (id))
SELECT pt.p_partkey AS issue_id, res.id, res.name,
       coalesce(res.files, CAST([] AS VARCHAR[])) AS files, coalesce(res.classes, CAST([] AS VARCHAR[])) AS classes,
       coalesce(res.called, CAST([] AS VARCHAR[])) AS called, res.owner_class
FROM part pt LEFT JOIN res ON pt.p_partkey = res.issue_id
"""
