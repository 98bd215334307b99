"""Symbol tables from a source-file table.

``parse`` runs the Python parser once per file (Arrow batches), cuts the
lineage so every consumer reuses the result, and the flat tables below are
narrow projections of it.  The symbol table and per-caller call lists are
the only aggregations, both partial (map-side) by construction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pyparse import SPARK_SCHEMA, parse_batches
from ..functions.sizing import spread
from ..session import cut_lineage

KIND_FUNCTION = 0
KIND_CLASS = 1


def parse(source_files: DataFrame, persist: bool = True, as_coded: bool = False) -> DataFrame:
    """One row per file: parse_error, functions, classes, imports, aliases.

    ``as_coded=True`` keeps the reference's always-empty lookups (SURVEY Q3-Q6)."""
    files = spread(source_files.select("snapshot_id", "path", "content"), "snapshot_id", "path")
    fn = (lambda it: parse_batches(it, True)) if as_coded else parse_batches
    parsed = files.mapInArrow(fn, SPARK_SCHEMA)
    return cut_lineage(parsed) if persist else parsed


def ok(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("parse_error").isNull())


def parse_errors(parsed: DataFrame) -> DataFrame:
    """Failing files, reported and excluded from everything else."""
    return parsed.filter(F.col("parse_error").isNotNull()).select("snapshot_id", "path", "parse_error")


def functions(parsed: DataFrame) -> DataFrame:
    """One row per function definition (nested and async included)."""
    return ok(parsed).select("snapshot_id", "path", F.inline("functions"))


def classes(parsed: DataFrame) -> DataFrame:
    """One row per class definition."""
    return ok(parsed).select("snapshot_id", "path", F.inline("classes"))


def imports(parsed: DataFrame) -> DataFrame:
    """(snapshot_id, path, pos, module), duplicates kept."""
    return ok(parsed).select("snapshot_id", "path", F.posexplode("imports").alias("pos", "module"))


def aliases(parsed: DataFrame) -> DataFrame:
    """(snapshot_id, path, alias, module), last binding per file wins."""
    return ok(parsed).select("snapshot_id", "path", F.inline("aliases"))


def self_rewrite(callee: Column, qualified_name: Column) -> Column:
    """X11: 'self.rest' -> 'Class.rest' when the function was defined inside a class."""
    cls = F.substring_index(qualified_name, ".", 1)
    return (F.when(callee.startswith("self.") & qualified_name.contains("."),
                   F.concat(cls, F.lit("."), F.substr(callee, F.lit(6))))
            .otherwise(callee))


def call_lists(parsed: DataFrame) -> DataFrame:
    """(snapshot_id, path, caller, callees): a later definition's list replaces earlier ones."""
    f = functions(parsed)
    rewritten = F.transform("calls", lambda c: self_rewrite(c, F.col("name")))
    return (f.select("snapshot_id", "path", F.col("name").alias("caller"), "def_ord", rewritten.alias("callees"))
            .groupBy("snapshot_id", "path", "caller")
            .agg(F.max_by("callees", "def_ord").alias("callees")))


def symbol_table(parsed: DataFrame) -> DataFrame:
    """(snapshot_id, name, symbol_id, kind): later file wins, classes beat functions
    within a file, later definitions beat earlier ones."""
    f = functions(parsed).select("snapshot_id", "path", "name", "def_ord", F.lit(KIND_FUNCTION).alias("kind"))
    c = classes(parsed).select("snapshot_id", "path", "name", "def_ord", F.lit(KIND_CLASS).alias("kind"))
    order = F.struct("path", "kind", "def_ord")
    return (f.unionByName(c)
            .groupBy("snapshot_id", "name")
            .agg(F.max_by(F.struct(F.concat("path", F.lit("::"), "name").alias("symbol_id"), "kind"), order).alias("w"))
            .select("snapshot_id", "name", "w.symbol_id", "w.kind"))
