"""synthetic Python source files derived from `part` rows.

One file per part, path pkg_<p_size>/part_<k>.py with k = p_partkey.  The
file is a fixed list of template lines, some present only under a condition:

  k0    k = 0 (class without a base)      new   k % 20 = 0 (Singleton __new__)
  dup   k % 30 = 0 (repeats helper_0)     every 50th file is cut inside a def

Each line carries the symbols whose source extent covers it, so the expected
symbols (span, snippet) follow from the same table in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

SNAPSHOT = "parts"

# The file template.  (condition, line, symbols covering the line)
LINES = (
    ("all", "import os", ""),
    ("all", "import pkg_{s} as P", ""),
    ("all", "from pkg_{s} import util", ""),
    ("k0", "class Part{k}:", "C"),
    ("notk0", "class Part{k}(Part{half}):", "C"),
    ("all", "    size = {s}", "C"),
    ("all", "    def price(self):", "C,price"),
    ("all", "        # price of {name}", "C,price"),
    ("all", "        self.check()", "C,price"),
    ("all", "        return helper_{kp1}(os.getpid())", "C,price"),
    ("all", "    @staticmethod", "C"),
    ("all", "    def check(x=1):", "C,check"),
    ("all", '        """check doc"""', "C,check"),
    ("all", "        return x", "C,check"),
    ("new", "    def __new__(cls):", "C,new"),
    ("new", "        cls._instance = 1", "C,new"),
    ("all", "def helper_{k}(v):", "helper"),
    ("all", "    return Part{k}.check(v)", "helper"),
    ("dup", "def helper_0(v):", "helper0"),
    ("dup", "    return v", "helper0"),
)
# The cut: lines before this index, then the unfinished def line.
CUT_AT = 6
CUT_LINE = "    def price(self"

# Symbols: tag -> (kind, name template, is_static, def order within the file)
SYMBOLS = (
    ("C", "class", "Part{k}", False, 0),
    ("price", "function", "Part{k}.price", False, 1),
    ("check", "function", "Part{k}.check", True, 2),
    ("new", "function", "Part{k}.__new__", False, 3),
    ("helper", "function", "helper_{k}", False, 4),
    ("helper0", "function", "helper_0", False, 5),
)


def _cond_spark(c: str, k: Column) -> Column:
    return {"all": F.lit(True), "k0": k == 0, "notk0": k != 0, "new": k % 20 == 0,
            "dup": k % 30 == 0}[c]


def _render_spark(tpl: str, k: Column, s: Column, name: Column) -> Column:
    out = F.lit(tpl)
    for ph, v in (("{k}", k), ("{s}", s), ("{half}", F.floor(k / 2)), ("{kp1}", k + 1), ("{name}", name)):
        if ph in tpl:
            out = F.replace(out, F.lit(ph), v.cast("string"))
    return out


def source_files(spark: SparkSession, sf: str) -> DataFrame:
    """(snapshot_id, path, content, blob_sha): the F1 corpus."""
    p = table(spark, sf, "part")
    k, s, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    full = F.array(*[F.when(_cond_spark(c, k), _render_spark(t, k, s, name)) for c, t, _ in LINES])
    cut = F.array(*[F.when(_cond_spark(c, k), _render_spark(t, k, s, name)) for c, t, _ in LINES[:CUT_AT]],
                  F.lit(CUT_LINE))
    lines = F.when(k % 50 == 0, cut).otherwise(full)
    content = F.concat(F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n"), F.lit("\n"))
    path = F.concat(F.lit("pkg_"), s.cast("string"), F.lit("/part_"), k.cast("string"), F.lit(".py"))
    return (p.select(F.lit(SNAPSHOT).alias("snapshot_id"), path.alias("path"), content.alias("content"))
            .withColumn("blob_sha", F.sha1(F.col("content"))))


# Files of the second snapshot that differ: one function more at the end.
CHANGED = 3


def second_snapshot(files: DataFrame) -> DataFrame:
    """The corpus a commit later: every file whose part key ends in CHANGED has one function more."""
    k = F.regexp_extract("path", r"part_(\d+)\.py$", 1)
    more = F.concat(F.lit("def extra_"), k, F.lit("():\n    return 1\n"))
    content = F.when(k.cast("long") % 10 == CHANGED, F.concat("content", more)).otherwise(F.col("content"))
    return files.select(F.lit("later").alias("snapshot_id"), "path", content.alias("content")).withColumn("blob_sha", F.sha1("content"))


# ---------------------------------------------------------------- SQL side

def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_COND_SQL = {"all": "TRUE", "k0": "k = 0", "notk0": "k <> 0", "new": "k % 20 = 0", "dup": "k % 30 = 0"}


def _render_sql(tpl: str) -> str:
    out = _q(tpl)
    for ph, v in (("{k}", "k"), ("{s}", "s"), ("{half}", "k // 2"), ("{kp1}", "k + 1"), ("{name}", "pname")):
        if ph in tpl:
            out = f"replace({out}, '{ph}', CAST({v} AS VARCHAR))"
    return out


def sql_lines() -> str:
    """CTE bodies: fp(k, s, pname, path, cut), fl(k, path, ln, text, tags) for parsed files."""
    vals = ", ".join(f"({i}, {_q(c)}, {_q(t)}, {_q(tags)})" for i, (c, t, tags) in enumerate(LINES))
    rendered = " ".join(f"WHEN {i} THEN {_render_sql(t)}" for i, (_, t, _) in enumerate(LINES))
    conds = " ".join(f"WHEN {_q(c)} THEN {v}" for c, v in _COND_SQL.items())
    return f"""
fp AS (SELECT p_partkey AS k, p_size AS s, p_name AS pname,
              'pkg_' || CAST(p_size AS VARCHAR) || '/part_' || CAST(p_partkey AS VARCHAR) || '.py' AS path,
              p_partkey % 50 = 0 AS cut FROM part),
tl AS (SELECT * FROM (VALUES {vals}) t(idx, cond, tpl, tags)),
fl0 AS (SELECT fp.k, fp.path, tl.idx, CASE tl.idx {rendered} END AS text, string_split(tl.tags, ',') AS tags,
               CASE tl.cond {conds} END AS keep
        FROM fp CROSS JOIN tl WHERE NOT fp.cut),
fl AS (SELECT k, path, CAST(row_number() OVER (PARTITION BY k ORDER BY idx) AS INTEGER) AS ln, text, tags
       FROM fl0 WHERE keep)
"""


def sql_symbols() -> str:
    """CTE body sym(k, path, tag, kind, name, lineno, col_offset, end_lineno, end_col_offset, code_snippet,
    is_static, def_ord)."""
    vals = ", ".join(f"({_q(t)}, {_q(kind)}, {_q(n)}, {str(st).upper()}, {o})" for t, kind, n, st, o in SYMBOLS)
    return f"""
st AS (SELECT * FROM (VALUES {vals}) t(tag, kind, ntpl, is_static, def_ord)),
ext AS (SELECT fl.k, fl.path, st.tag, min(fl.ln) AS l0, max(fl.ln) AS l1,
               string_agg(fl.text, '\n' ORDER BY fl.ln) AS body
        FROM fl JOIN st ON list_contains(fl.tags, st.tag) GROUP BY fl.k, fl.path, st.tag),
sym AS (SELECT ext.k, ext.path, ext.tag, st.kind, replace(st.ntpl, '{{k}}', CAST(ext.k AS VARCHAR)) AS name,
               l0 AS lineno, CAST(length(body) - length(ltrim(body, ' ')) AS INTEGER) AS col_offset, l1 AS end_lineno,
               ltrim(body, ' ') AS code_snippet, st.is_static, st.def_ord
        FROM ext JOIN st USING (tag)),
symx AS (SELECT *, CAST(CASE WHEN lineno = end_lineno THEN col_offset + strlen(code_snippet)
                             ELSE strlen(string_split(code_snippet, '\n')[-1]) END AS INTEGER) AS end_col_offset
         FROM sym)
"""
