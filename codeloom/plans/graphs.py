"""Property-graph queries over the provided tables.

* events -> User nodes and REFERS edges (upsert semantics, latest (ts, event_id) wins)
* customer/orders -> detach delete of one market segment
* customer/orders/lineitem/part/supplier -> neighbourhood of seed orders per customer
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import neighbourhood as _neighbourhood
from ..operators.upsert import EDGE_KEY, NODE_KEY, detach_delete as _detach, flatten_props, upsert_edges, upsert_nodes
from ..sources.tables import table

# Neighbours a page in ``neighbourhood_hub``.
HUB_PAGE = 256
# Fixed value: the market segment removed by the detach-delete query.
DELETED_SEGMENT = "AUTOMOBILE"


def _cents(c):
    return F.round(F.col(c) * 100).cast("long").cast("string")


def _k():
    return F.get_json_object("props", "$.k")


def user_node_updates(ev: DataFrame) -> DataFrame:
    """Each event overlays: <event_type> -> cents, last_type, and k (an error removes k)."""
    props = F.create_map(F.col("event_type"), _cents("value"),
                         F.lit("last_type"), F.col("event_type"),
                         F.lit("k"), F.when(F.col("event_type") != "error", _k()))
    return ev.select(F.lit("User").alias("label"), F.col("user_id").cast("string").alias("id"),
                     props.alias("props"), F.struct("ts", "event_id").alias("ord"))


def node_upsert(spark: SparkSession, sf: str) -> DataFrame:
    nodes = upsert_nodes(user_node_updates(table(spark, sf, "events")))
    return flatten_props(nodes, NODE_KEY)


def node_upsert_state(spark: SparkSession, sf: str) -> DataFrame:
    """C1 against a stored graph: two snapshots with the same ids, their updates arriving in two batches (by time)."""
    from ..operators.graph_state import GraphState
    ev = table(spark, sf, "events")
    at = F.col("ts").cast("timestamp").cast("long")
    middle = ev.agg(((F.min(at) + F.max(at)) / 2).alias("t"))
    state = GraphState(spark)
    for part in (at <= middle.scalar(), at > middle.scalar()):
        for i, snapshot in enumerate(("even", "odd")):
            updates = user_node_updates(ev.where(part & (F.pmod("event_id", F.lit(2)) == i)))
            state.apply_nodes(updates.withColumn("snapshot_id", F.lit(snapshot)))
    return flatten_props(state.nodes(), ["snapshot_id", *NODE_KEY])


def edge_upsert(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    signed_up = upsert_nodes(user_node_updates(ev.filter(F.col("event_type") == "signup")))
    updates = ev.select(F.lit("User").alias("src_label"), F.col("user_id").cast("string").alias("src_id"),
                        F.lit("REFERS").alias("rel"), F.lit("User").alias("dst_label"), _k().alias("dst_id"),
                        F.create_map(F.lit("type"), F.col("event_type"), F.lit("cents"), _cents("value")).alias("props"),
                        F.struct("ts", "event_id").alias("ord"))
    return flatten_props(upsert_edges(updates, signed_up), EDGE_KEY)


def _order_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer")
    o = table(spark, sf, "orders")
    nodes = (c.select(F.lit("Customer").alias("label"), F.col("c_custkey").cast("string").alias("id"))
             .unionByName(o.select(F.lit("Order").alias("label"), F.col("o_orderkey").cast("string").alias("id"))))
    edges = o.select(F.lit("Customer").alias("src_label"), F.col("o_custkey").cast("string").alias("src_id"),
                     F.lit("PLACED").alias("rel"), F.lit("Order").alias("dst_label"),
                     F.col("o_orderkey").cast("string").alias("dst_id"))
    return nodes, edges


def detach_delete(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges = _order_graph(spark, sf)
    doomed = (table(spark, sf, "customer").filter(F.col("c_mktsegment") == DELETED_SEGMENT)
              .select(F.lit("Customer").alias("label"), F.col("c_custkey").cast("string").alias("id")))
    kn, ke = _detach(nodes, edges, doomed)
    null = F.lit(None).cast("string")
    return (kn.select(F.lit("node").alias("kind"), "label", "id", null.alias("rel"),
                      null.alias("dst_label"), null.alias("dst_id"))
            .unionByName(ke.select(F.lit("edge").alias("kind"), F.col("src_label").alias("label"),
                                   F.col("src_id").alias("id"), "rel", "dst_label", "dst_id")))


def _commerce_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    li = table(spark, sf, "lineitem")
    s_ = lambda x: F.col(x).cast("string")
    nodes = (c.select(F.lit("Customer").alias("label"), s_("c_custkey").alias("id"), F.col("c_name").alias("name"))
             .unionByName(o.select(F.lit("Order").alias("label"), s_("o_orderkey").alias("id"),
                                   F.concat(F.lit("order_"), s_("o_orderkey")).alias("name")))
             .unionByName(p.select(F.lit("Part").alias("label"), s_("p_partkey").alias("id"), F.col("p_name").alias("name")))
             .unionByName(s.select(F.lit("Supplier").alias("label"), s_("s_suppkey").alias("id"), F.col("s_name").alias("name"))))
    def rel(df, src_label, src, name, dst_label, dst):
        # dedupe on the numeric keys, then attach the constant labels
        return (df.select(F.col(src).alias("s"), F.col(dst).alias("d")).distinct()
                .select(F.lit(src_label).alias("src_label"), s_("s").alias("src_id"), F.lit(name).alias("rel"),
                        F.lit(dst_label).alias("dst_label"), s_("d").alias("dst_id")))
    edges = (rel(o, "Customer", "o_custkey", "PLACED", "Order", "o_orderkey")
             .unionByName(rel(li, "Order", "l_orderkey", "CONTAINS", "Part", "l_partkey"))
             .unionByName(rel(li, "Supplier", "l_suppkey", "SHIPPED", "Order", "l_orderkey")))
    return nodes, edges


def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """Issues are customers; their seeds are the names of their orders (primary label Order)."""
    nodes, edges = _commerce_graph(spark, sf)
    o = table(spark, sf, "orders")
    issues = table(spark, sf, "customer").select(F.col("c_custkey").alias("issue_id"))
    seeds = o.select(F.col("o_custkey").alias("issue_id"),
                     F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")).alias("name"))
    rel = {"files": ("PLACED", "in", "Customer"),
           "classes": ("SHIPPED", "in", "Supplier"),
           "called": ("CONTAINS", "out", "Part")}
    return _neighbourhood(issues, seeds, nodes, edges, issue_id="issue_id", label="Order", relations=rel)


def neighbourhood_hub(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of hub nodes, flattened: each return flag is a node that about a third of all line items' orders hang on."""
    from ..operators.match import neighbour_pages
    li = table(spark, sf, "lineitem")
    edges = li.select(F.lit("Flag").alias("src_label"), F.col("l_returnflag").alias("src_id"), F.lit("MARKS").alias("rel"),
                      F.lit("Order").alias("dst_label"), F.col("l_orderkey").cast("string").alias("dst_id"))
    hubs = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("pid")).distinct()
    pages = neighbour_pages(hubs, edges, page=HUB_PAGE)
    return pages.select("pid", "rel", "page", F.col("n").alias("page_size"), F.posexplode("vals").alias("pos", "neighbour"))
