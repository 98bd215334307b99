"""Pattern finder, docstrings, inline comments, usage context, snippet build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import exchanged, spread
from ..functions.text import py_strip, splitlines


def inline_comments(code: Column | str) -> Column:
    """Array of comments, one per line holding '#': from the first '#' to the end
    of the stripped line, kept if longer than 2 characters, in line order."""
    c = F.col(code) if isinstance(code, str) else code
    # Only lines with the sign are stripped, which takes it from none.
    stripped = F.transform(F.filter(splitlines(c), lambda l: l.contains("#")), lambda l: py_strip(l))
    found = F.transform(stripped, lambda l: F.substr(l, F.instr(l, "#")))
    return F.filter(found, lambda x: F.length(x) > 2)


def explode_comments(df: DataFrame, code: str, keep: list[str]) -> DataFrame:
    """One row per kept comment with its renumbered position ``i`` (no shuffle)."""
    some = spread(df, *keep).where(F.col(code).contains("#"))
    return some.select(*keep, F.posexplode(inline_comments(code)).alias("i", "comment"))


def singleton_classes(classes: DataFrame, code: str = "code_snippet") -> DataFrame:
    """Classes whose text holds both '__new__' and 'cls._instance'."""
    return classes.filter(F.col(code).contains("__new__") & F.col(code).contains("cls._instance"))


def _usage(funcs: DataFrame, calls: DataFrame) -> DataFrame:
    """X18: 'name calls: a, b' from the caller's list, else (missing or empty) the list of its
    last dotted segment in the same file; no row when both are empty."""
    # One join by file: a file's lists are a map (one list a caller), looked up by either name.
    lists = (calls.where(F.size("callees") > 0).groupBy("snapshot_id", "path")
             .agg(F.map_from_entries(F.collect_list(F.struct("caller", "callees"))).alias("lists")))
    tail = F.element_at(F.split("name", "\\."), -1)
    u = (funcs.select("snapshot_id", "path", "name", "sid").join(exchanged(lists), ["snapshot_id", "path"])
         .withColumn("cl", F.coalesce(F.try_element_at("lists", F.col("name")), F.try_element_at("lists", tail))))
    return u.filter(F.col("cl").isNotNull()).select(
        "snapshot_id", "path", "name", "sid",
        F.concat(F.col("name"), F.lit(" calls: "), F.array_join("cl", ", ")).alias("usage"))


def build_snippets(funcs: DataFrame, classes: DataFrame, calls: DataFrame) -> DataFrame:
    """The snippet bag (duplicate snippet_ids kept):
    functions -> function_code, docstring?, comment*, usage_context?; classes -> class_code, docstring?, comment*.
    ``lineno`` is set only on code rows."""
    f = funcs.filter(F.col("code_snippet") != "").withColumn(
        "sid", F.concat("path", F.lit("::func::"), "name"))
    c = classes.filter(F.col("code_snippet") != "").withColumn(
        "sid", F.concat("path", F.lit("::class::"), "name"))
    null_line = F.lit(None).cast("int")

    def rows(df, code_type):
        code = df.select("snapshot_id", F.col("code_snippet").alias("text"), F.lit(code_type).alias("type"),
                         F.col("path").alias("file"), "name", F.col("lineno").cast("int").alias("lineno"),
                         F.col("sid").alias("snippet_id"))
        doc = df.filter(F.col("docstring").isNotNull() & (F.col("docstring") != "")).select(
            "snapshot_id", F.col("docstring").alias("text"), F.lit("docstring").alias("type"),
            F.col("path").alias("file"), "name", null_line.alias("lineno"),
            F.concat("sid", F.lit("::docstring")).alias("snippet_id"))
        com = explode_comments(df, "code_snippet", ["snapshot_id", "path", "name", "sid"]).select(
            "snapshot_id", F.col("comment").alias("text"), F.lit("comment").alias("type"),
            F.col("path").alias("file"), "name", null_line.alias("lineno"),
            F.concat("sid", F.lit("::comment::"), F.col("i").cast("string")).alias("snippet_id"))
        return code.unionByName(doc).unionByName(com)

    usage = _usage(f, calls).select(
        "snapshot_id", F.col("usage").alias("text"), F.lit("usage_context").alias("type"),
        F.col("path").alias("file"), "name", null_line.alias("lineno"),
        F.concat("sid", F.lit("::usage")).alias("snippet_id"))
    return rows(f, "function_code").unionByName(usage).unionByName(rows(c, "class_code"))
