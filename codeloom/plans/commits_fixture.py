"""commits derived from events.

hexsha = event_id, author = user_id, message = event_type, committed_date = ts;
parent = an earlier event named by the row itself (event_id - 1 - event_id % 3; a
stub node if there is none), none for every 10th event; every 25th event's parent
is replaced by 'missing_<event_id>' (a stub node).  One diff per event on f_<props.k>.py: error -> D with empty b_path
(except every 40th, which keeps it and so becomes MODIFIES), signup -> A,
others -> M.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import commit_graph as _graph
from ..sources.tables import table


def commits(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    ev = ev.withColumn("prev_id", F.when(F.col("event_id") % 10 != 0, F.col("event_id") - 1 - F.col("event_id") % 3))
    eid = F.col("event_id").cast("string")
    parents = (F.when(F.col("prev_id").isNull(), F.array().cast("array<string>"))
               .when(F.col("event_id") % 25 == 0, F.array(F.concat(F.lit("missing_"), eid)))
               .otherwise(F.array(F.col("prev_id").cast("string"))))
    path = F.concat(F.lit("f_"), F.get_json_object("props", "$.k"), F.lit(".py"))
    et = F.col("event_type")
    change = F.when(et == "error", "D").when(et == "signup", "A").otherwise("M")
    a_path = F.when(et == "signup", F.lit("")).otherwise(path)
    b_path = F.when((et == "error") & (F.col("event_id") % 40 != 0), F.lit("")).otherwise(path)
    text = F.concat(F.lit("@@ "), et, F.lit(" "), F.round(F.col("value") * 100).cast("long").cast("string"))
    diff = F.struct(a_path.alias("a_path"), b_path.alias("b_path"), change.alias("change_type"),
                    text.alias("diff_text"))
    return ev.select(eid.alias("hexsha"), F.col("user_id").cast("string").alias("author"),
                     et.alias("message"), F.col("ts").alias("committed_date"), parents.alias("parents"),
                     F.array(diff).alias("diffs"))


def commit_graph(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _graph(commits(spark, sf))
    null = F.lit(None).cast("string")
    n = nodes.select(F.lit("node").alias("kind"), F.col("label").alias("src_label"), F.col("id").alias("src_id"),
                     null.alias("rel"), null.alias("dst_label"), null.alias("dst_id"),
                     F.explode("props").alias("prop", "value"))
    e = edges.select(F.lit("edge").alias("kind"), "src_label", "src_id", "rel", "dst_label", "dst_id",
                     F.explode_outer("props").alias("prop", "value"))
    return n.unionByName(e)
