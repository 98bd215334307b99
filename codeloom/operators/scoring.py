"""Candidate patch scores, weighted total, best per issue, diagnostics.

All scores but the syntax check are native column expressions.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import splitlines

# Weights of the eight scores, in summation order.
WEIGHTS = (("patch_size", 0.15), ("syntax", 0.15), ("style", 0.10), ("exception", 0.10),
           ("docstring", 0.10), ("variable", 0.10), ("pattern", 0.10), ("llm", 0.20))
SIZE_THRESHOLD = 30
STYLE_IF_NO_LINTER = 0.8
LLM_DEFAULT = 0.5
# The reference's score patterns (the Java flag prefixes and the separators that Python also counts as space are ours).
BARE_EXCEPT_RE = r"(?U)except[\s\x1C-\x1F]*:"
BROAD_EXCEPT_RE = r"(?U)except[\s\x1C-\x1F]+Exception"
DOCSTRING_RE = "(?s)\"\"\".*?\"\"\"|'''.*?'''"
ASSIGNMENT_RE = r"(?Ud)(\w+)[\s\x1C-\x1F]*=.*"
NUMBER_RE = r"\d*\.?\d+"


# Decimal digits beyond ASCII, which Python's pattern and float() read as well; they come in tens, 0 to 9.
_DIGITS = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Nd")


def size_score(diff: Column, threshold: int = SIZE_THRESHOLD) -> Column:
    """K6: 1 - min((added + removed) / threshold, 1); '+++'/'---' lines not counted."""
    lines = splitlines(diff)
    added = F.size(F.filter(lines, lambda l: l.startswith("+") & ~l.startswith("+++")))
    removed = F.size(F.filter(lines, lambda l: l.startswith("-") & ~l.startswith("---")))
    return F.lit(1.0) - F.least((added + removed) / F.lit(float(threshold)), F.lit(1.0))


@F.pandas_udf(T.DoubleType())
def syntax_score(code: pd.Series) -> pd.Series:
    """K7: 1.0 if the code parses, 0.0 on a syntax error, null if the check itself fails."""
    import ast

    def one(s):
        if s is None:
            return None
        try:
            ast.parse(s)
            return 1.0
        except SyntaxError:
            return 0.0
        except Exception:  # noqa: BLE001 - recursion/memory limits: candidate is dropped (K15)
            return None
    return code.map(one).astype("float64")


def style_score(lint_issues: Column | None = None) -> Column:
    """K8: 1 - min(issues / 10, 1) from a caller-supplied lint count; 0.8 without a linter."""
    if lint_issues is None:
        return F.lit(STYLE_IF_NO_LINTER)
    return F.lit(1.0) - F.least(lint_issues.cast("double") / 10.0, F.lit(1.0))


def exception_score(code: Column) -> Column:
    """K9: bare except 0.3, else 'except Exception' 0.6, else 1."""
    return (F.when(code.rlike(BARE_EXCEPT_RE), F.lit(0.3))
            .when(code.rlike(BROAD_EXCEPT_RE), F.lit(0.6))
            .otherwise(F.lit(1.0)))


def docstring_score(code: Column) -> Column:
    """0 if any triple-quoted block, else 1."""
    return F.when(code.rlike(DOCSTRING_RE), F.lit(0.0)).otherwise(F.lit(1.0))


def variable_score(code: Column) -> Column:
    """At most 5 distinct assigned names (one match per line) -> 1, else 0.6."""
    names = F.regexp_extract_all(code, F.lit(ASSIGNMENT_RE), F.lit(1))
    return F.when(F.size(F.array_distinct(names)) <= 5, F.lit(1.0)).otherwise(F.lit(0.6))


def pattern_score(code: Column) -> Column:
    """Try:/except/continue all present -> 1, else 0.5."""
    ok = code.contains("try:") & code.contains("except") & code.contains("continue")
    return F.when(ok, F.lit(1.0)).otherwise(F.lit(0.5))


def llm_score(reply: Column) -> Column:
    """First number in the model reply, clamped to [0, 1]; 0.5 if none or no reply."""
    num = F.regexp_extract(F.translate(reply, _DIGITS, "0123456789" * (len(_DIGITS) // 10)), NUMBER_RE, 0).try_cast("double")
    # least/greatest skip nulls, so the fallback must be decided first.
    return F.when(num.isNull(), F.lit(LLM_DEFAULT)).otherwise(F.greatest(F.lit(0.0), F.least(num, F.lit(1.0))))


def total_score(cols: dict[str, Column], weights=WEIGHTS) -> Column:
    """Weighted sum in fixed order (absent weight = 0), rounded to 4 places."""
    acc = None
    for name, w in weights:
        term = cols[name] * F.lit(w)
        acc = term if acc is None else acc + term
    return F.round(acc, 4)


def score(cands: DataFrame, *, func: str = "func", diff: str = "diff",
          model_reply: str | None = None, lint_issues: str | None = None) -> DataFrame:
    """Add the eight scores and the total; drop candidates whose check failed."""
    code = F.col(func)
    parts = {
        "patch_size": size_score(F.col(diff)),
        "syntax": syntax_score(code),
        "style": style_score(F.col(lint_issues) if lint_issues else None),
        "exception": exception_score(code),
        "docstring": docstring_score(code),
        "variable": variable_score(code),
        "pattern": pattern_score(code),
        "llm": llm_score(F.col(model_reply)) if model_reply else F.lit(LLM_DEFAULT),
    }
    out = cands
    for name, c in parts.items():
        out = out.withColumn(name, c)
    out = out.filter(F.col("syntax").isNotNull())
    return out.withColumn("total", total_score({n: F.col(n) for n in parts}))


def best_per_issue(scored: DataFrame, issue_id: str) -> DataFrame:
    """Highest total, first patch on ties; one row per issue with a scored candidate."""
    pick = F.max_by(F.struct("patch_id", "total", "func"), F.struct(F.col("total"), -F.col("patch_id")))
    return (scored.groupBy(issue_id)
            .agg(pick.alias("best"), F.count(F.lit(1)).alias("n_scored"))
            .select(issue_id, F.col("best.patch_id").alias("best_patch_id"),
                    F.col("best.total").alias("best_total"), F.col("best.func").alias("best_func"),
                    "n_scored"))


def bundle(meta: DataFrame, scored: DataFrame, issue_id: str) -> DataFrame:
    """Per reply: file, function, counts, best patch (null-safe), quarantine text."""
    best = best_per_issue(scored, issue_id)
    return (meta.join(best, issue_id, "left")
            .select(issue_id, "file_name", "function_name", "n_blocks",
                    F.coalesce("n_scored", F.lit(0)).alias("n_scored"),
                    "best_patch_id", "best_total", "best_func",
                    F.when(F.coalesce("n_scored", F.lit(0)) == 0,
                           F.substr(F.col("reply"), F.lit(1), F.lit(400))).alias("quarantine")))
