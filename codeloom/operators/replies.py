"""P5 and K1-K5: parsing model replies into queries and candidate patches.

Python-regex semantics are kept with Java flags: (?s) DOTALL, (?d) so that
'.' and '$' only treat '\\n' as a line end, (?U) for Unicode \\w, \\s, \\d.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip

# The headers and markers of the reply format, and the patterns that
# cut replies into queries and candidates (the reference's patterns; only the Java
# flag prefixes are ours, to keep Python's matching rules).
STEP2 = "### Step 2:"
FULL_HDR = "#### Candidate Patch (Full Function)"
DIFF_HDR = "#### Candidate Patch (Unified Diff)"
UNKNOWN_FILE = "unknown_file.py"
UNKNOWN_FUNCTION = "unknown_function"
_BLOCK_RE = r"(?d)(#### Candidate Patch \(Full Function\)[\s\S]*?)(?=#### Candidate Patch \(Full Function\)|$)"
_FULL_RE = r"(?s)#### Candidate Patch \(Full Function\)(.*?)(?=#### Candidate Patch \(Unified Diff\))"
_DIFF_RE = r"(?s)#### Candidate Patch \(Unified Diff\)(.*)"
_STRICT_RE = (r"(?sd)#### Candidate Patch \(Full Function\)\n# Candidate Patch (\d+)[\s\S]*?# File: .*?\n\n(.*?)\n+"
              r"#### Candidate Patch \(Unified Diff\)\n# Candidate Patch \1 \(Unified Diff\)\n\n(---.*?)\n(?=####|$)")
_VEC_Q_RE = r"(?sd)vector_query:\s*\|\s*(.*?)\n(?:cypher_query:|$)"
_CYP_Q_RE = r"(?sd)cypher_query:\s*\|\s*(.*)"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _regex_group_or_empty(text: Column, pattern: str, idx: int) -> Column:
    """Group ``idx`` of the first match, "" when there is none (also when the group is empty)."""
    return F.coalesce(F.regexp_extract(text, pattern, idx), F.lit(""))


def parse_queries(reply: Column | str) -> tuple[Column, Column]:
    """P5: (vector_query, cypher_query) from a two-block reply; "" when missing."""
    r = _c(reply)
    return (py_strip(_regex_group_or_empty(r, _VEC_Q_RE, 1)),
            py_strip(_regex_group_or_empty(r, _CYP_Q_RE, 1)))


def split_steps(reply: Column | str) -> tuple[Column, Column, Column]:
    """K1: (has_step2, step1_text, step2_text), split at the first '### Step 2:'."""
    r = _c(reply)
    pos = F.instr(r, STEP2)
    has = pos > 0
    step1 = F.when(has, F.substr(r, F.lit(1), pos - 1))
    step2 = F.when(has, F.substr(r, pos + len(STEP2)))
    return has, step1, step2


def _last_value(lines: Column, marker: str, exclude: str | None) -> Column:
    def keep(line):
        c = line.contains(marker)
        return c & ~line.contains(exclude) if exclude else c
    hits = F.filter(lines, keep)
    last = F.element_at(hits, -1)
    return F.when(F.size(hits) > 0, py_strip(F.element_at(F.split(last, marker, -1), 2)))


def localisation(step1: Column) -> tuple[Column, Column]:
    """K2: (file, function): last line holding 'File:' (else 'Function:'), text between the
    first and second marker, stripped; defaults when absent."""
    lines = F.split(py_strip(step1), "\n", -1)
    f = _last_value(lines, "File:", None)
    fn = _last_value(lines, "Function:", "File:")
    return (F.coalesce(f, F.lit(UNKNOWN_FILE)), F.coalesce(fn, F.lit(UNKNOWN_FUNCTION)))


def candidate_blocks(step2: Column) -> Column:
    """K3: array of candidate blocks, each starting at a full-function header."""
    return F.coalesce(F.regexp_extract_all(step2, F.lit(_BLOCK_RE), F.lit(1)),
                      F.array().cast("array<string>"))


def block_parts(block: Column) -> tuple[Column, Column]:
    """K4: (func, diff) text between the headers, stripped; "" when missing."""
    return (py_strip(_regex_group_or_empty(block, _FULL_RE, 1)),
            py_strip(_regex_group_or_empty(block, _DIFF_RE, 1)))


def extract(replies: DataFrame, issue_id: str, reply: str = "reply") -> tuple[DataFrame, DataFrame]:
    """K1-K4 over a reply table.

    Returns (meta, candidates): meta is one row per reply with file, function
    and the number of blocks; candidates is one row per block with patch_id
    = position + 1.  Block explosion is narrow: no shuffle.
    """
    has, step1, step2 = split_steps(reply)
    f, fn = localisation(step1)
    blocks = F.when(has, candidate_blocks(step2)).otherwise(F.array().cast("array<string>"))
    base = replies.select(issue_id, reply, has.alias("has_step2"),
                          F.when(has, f).otherwise(F.lit(UNKNOWN_FILE)).alias("file_name"),
                          F.when(has, fn).otherwise(F.lit(UNKNOWN_FUNCTION)).alias("function_name"),
                          blocks.alias("blocks"))
    meta = base.select(issue_id, reply, "has_step2", "file_name", "function_name",
                       F.size("blocks").alias("n_blocks"))
    ex = base.select(issue_id, F.posexplode("blocks").alias("pos", "block"))
    func, diff = block_parts(F.col("block"))
    cands = ex.select(issue_id, (F.col("pos") + 1).alias("patch_id"), func.alias("func"), diff.alias("diff"))
    return meta, cands


def extract_strict(replies: DataFrame, issue_id: str, reply: str = "reply") -> DataFrame:
    """K5: strict single-regex format with a back-reference to the patch number."""
    r = F.col(reply)
    funcs = F.regexp_extract_all(r, F.lit(_STRICT_RE), F.lit(2))
    diffs = F.regexp_extract_all(r, F.lit(_STRICT_RE), F.lit(3))
    z = F.arrays_zip(funcs.alias("f"), diffs.alias("d"))
    ex = replies.select(issue_id, F.posexplode(z).alias("pos", "m"))
    return ex.select(issue_id, (F.col("pos") + 1).alias("patch_id"),
                     py_strip(F.col("m.f")).alias("func"), py_strip(F.col("m.d")).alias("diff"))
