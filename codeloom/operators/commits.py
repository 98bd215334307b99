"""Commit history as graph nodes and edges, through the upserts of C1/C2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .upsert import upsert_edges, upsert_nodes


def iso_timestamp(ts: Column) -> Column:
    """datetime.isoformat(): microseconds only when non-zero."""
    frac = F.unix_micros(ts.cast("timestamp")) % 1_000_000
    return (F.when(frac == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
            .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))


def _basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def _empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def commit_graph(commits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """commits: (hexsha, author, message, committed_date, parents array, diffs array<struct>).

    Returns (nodes, edges) with keys (label, id) / (src_label, src_id, rel, dst_label, dst_id).
    """
    # The commit table fans out to six node/edge projections: materialise it once.
    c = cut_lineage(commits)
    full = c.select(F.lit("Commit").alias("label"), F.col("hexsha").alias("id"),
                    F.create_map(F.lit("hexsha"), F.col("hexsha"), F.lit("author"), F.col("author"),
                                 F.lit("message"), F.col("message"),
                                 F.lit("timestamp"), iso_timestamp(F.col("committed_date"))).alias("props"),
                    F.lit(1).alias("ord"))
    par = c.select("hexsha", F.explode("parents").alias("parent"))
    # C17: parents are merged by hexsha only, so an existing parent keeps its properties.
    stubs = par.select(F.lit("Commit").alias("label"), F.col("parent").alias("id"),
                       F.create_map(F.lit("hexsha"), F.col("parent")).alias("props"), F.lit(0).alias("ord"))
    d = c.select("hexsha", F.posexplode("diffs").alias("pos", "d"))
    mod = d.filter(~_empty(F.col("d.b_path")))
    dele = d.filter(_empty(F.col("d.b_path")) & ~_empty(F.col("d.a_path")) & (F.col("d.change_type") == "D"))
    files = (mod.select(F.col("d.b_path").alias("p")).unionByName(dele.select(F.col("d.a_path").alias("p")))
             .select(F.lit("File").alias("label"), F.col("p").alias("id"),
                     F.create_map(F.lit("path"), F.col("p"), F.lit("name"), _basename(F.col("p"))).alias("props"),
                     F.lit(0).alias("ord")))
    # read by the caller and by the edge endpoint check
    nodes = cut_lineage(upsert_nodes(full.unionByName(stubs).unionByName(files)))

    eprops = F.create_map(F.lit("change_type"), F.col("d.change_type"), F.lit("diff_text"), F.col("d.diff_text"))
    parent_of = par.select(F.lit("Commit").alias("src_label"), F.col("hexsha").alias("src_id"),
                           F.lit("PARENT_OF").alias("rel"), F.lit("Commit").alias("dst_label"),
                           F.col("parent").alias("dst_id"),
                           F.create_map().cast("map<string,string>").alias("props"), F.lit(0).alias("ord"))
    modifies = mod.select(F.lit("Commit").alias("src_label"), F.col("hexsha").alias("src_id"),
                          F.lit("MODIFIES").alias("rel"), F.lit("File").alias("dst_label"),
                          F.col("d.b_path").alias("dst_id"), eprops.alias("props"), F.col("pos").alias("ord"))
    deletes = dele.select(F.lit("Commit").alias("src_label"), F.col("hexsha").alias("src_id"),
                          F.lit("DELETES").alias("rel"), F.lit("File").alias("dst_label"),
                          F.col("d.a_path").alias("dst_id"), eprops.alias("props"), F.col("pos").alias("ord"))
    edges = upsert_edges(parent_of.unionByName(modifies).unionByName(deletes), nodes)
    return nodes, edges
