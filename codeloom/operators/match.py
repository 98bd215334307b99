"""The graph-neighbourhood query family, as joins and grouped collects.

For primary nodes matched by name (G1), each related set is one optional
one-hop expansion along a typed relation (G2), aggregated separately with a
sorted distinct collect (G6) and left-joined back, so chained optional
matches never multiply rows.  Issues without a match keep one row of empty
lists (G11).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sizing import exchanged, fits_bytes
from ..session import cut_lineage
from .ranking import top_k

# Ids sent whole to the edges, or range starts to the neighbours, at most.
FEW_BYTES = 8 << 20


def _empty():
    return F.array().cast("array<string>")


def seed_match(seeds: DataFrame, nodes: DataFrame, label: str, issue_id: str,
               by: Sequence[str] = ()) -> DataFrame:
    """G1: (issue_id, by..., pid, pname) for nodes of ``label`` whose name is among the issue's
    seeds (within the issue's own collection when ``by`` is given)."""
    n = nodes.filter(F.col("label") == label).select(*by, F.col("id").alias("pid"), F.col("name").alias("pname"))
    s = seeds.select(issue_id, *by, F.col("name").alias("pname")).distinct()
    return s.join(exchanged(n), [*by, "pname"])


def expand(edges: DataFrame, nodes: DataFrame, pids: DataFrame, label: str, rel: str,
           direction: str, other_label: str, prop: str = "name", by: Sequence[str] = ()) -> DataFrame:
    """G2 + G6: per primary id, the sorted distinct ``prop`` of neighbours along ``rel``.

    ``direction`` is "out" (primary -> other) or "in" (other -> primary).
    """
    if direction == "out":
        e = edges.filter((F.col("rel") == rel) & (F.col("src_label") == label) & (F.col("dst_label") == other_label))
        e = e.select(*by, F.col("src_id").alias("pid"), F.col("dst_id").alias("oid"))
    else:
        e = edges.filter((F.col("rel") == rel) & (F.col("dst_label") == label) & (F.col("src_label") == other_label))
        e = e.select(*by, F.col("dst_id").alias("pid"), F.col("src_id").alias("oid"))
    e = e.join(pids, [*by, "pid"], "left_semi")
    o = nodes.filter(F.col("label") == other_label).select(*by, F.col("id").alias("oid"), F.col(prop).alias("v"))
    return (e.join(o, [*by, "oid"])
            .groupBy(*by, "pid")
            .agg(F.array_sort(F.collect_set("v")).alias("vals")))


def one_hop(edges: DataFrame, pids: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Per primary id, every immediate neighbour in either direction as 'Label:id'."""
    out = (edges.filter(F.col("src_label") == label)
           .select(*by, F.col("src_id").alias("pid"), F.concat_ws(":", "dst_label", "dst_id").alias("nb")))
    inc = (edges.filter(F.col("dst_label") == label)
           .select(*by, F.col("dst_id").alias("pid"), F.concat_ws(":", "src_label", "src_id").alias("nb")))
    return (out.unionByName(inc).join(pids, [*by, "pid"], "left_semi")
            .groupBy(*by, "pid").agg(F.array_sort(F.collect_set("nb")).alias("vals")))


def neighbourhood(issues: DataFrame, seeds: DataFrame, nodes: DataFrame, edges: DataFrame, *,
                  issue_id: str, label: str,
                  relations: Mapping[str, tuple[str, str, str]],
                  with_one_hop: bool = True, limit: int | None = None,
                  by: Sequence[str] = ()) -> DataFrame:
    """Per (issue, primary): name plus one sorted list per relation spec.

    ``nodes``: (label, id, name, ...); ``edges``: (src_label, src_id, rel, dst_label, dst_id).
    ``relations``: output column -> (rel, "in"|"out", other_label).
    ``by``: collection columns present in seeds, nodes and edges (node ids are unique per collection).

    One pass: every edge touching a primary is seen from the primary's side with the relations it
    answers as bits, joined to its other end's node once, and brought to its primary once; there
    edges of other nodes fall out (before both, if the ids are few) and all lists come out of one
    aggregation with a conditional distinct collect per relation (G6), so no relation multiplies another.
    """
    by = list(by)
    # The matched primaries feed the aggregation and the final rows: materialise once.
    prim = cut_lineage(seed_match(seeds, nodes, label, issue_id, by))
    pids = prim.select(*by, "pid").distinct()

    def bits(direction: str, rel: str, other: str):
        asked = [F.when((F.col(rel) == r) & (F.col(other) == o), F.lit(1 << i)).otherwise(F.lit(0))
                 for i, (r, d, o) in enumerate(relations.values()) if d == direction]
        return sum(asked, F.lit(0)).cast("long")

    out_e = edges.filter(F.col("src_label") == label).select(
        *by, F.col("src_id").alias("pid"), bits("out", "rel", "dst_label").alias("asked"),
        F.col("dst_label").alias("olabel"), F.col("dst_id").alias("oid"))
    in_e = edges.filter(F.col("dst_label") == label).select(
        *by, F.col("dst_id").alias("pid"), bits("in", "rel", "src_label").alias("asked"),
        F.col("src_label").alias("olabel"), F.col("src_id").alias("oid"))
    touch = out_e.unionByName(in_e)
    if not with_one_hop:
        touch = touch.filter(F.col("asked") != 0)
    few = fits_bytes(pids, [*by, "pid"], max_bytes=FEW_BYTES)
    if few:
        touch = touch.join(F.broadcast(pids), [*by, "pid"], "left_semi")
    # Names only for the labels a relation asks for (the filter reaches each label's
    # source); one-hop needs no names.
    labels = sorted({o for _, _, o in relations.values()})
    other = (nodes.filter(F.col("label").isin(labels))
             .select(*by, F.col("label").alias("olabel"), F.col("id").alias("oid"), F.col("name").alias("v")))
    named = touch.join(exchanged(other), [*by, "olabel", "oid"], "left")
    # One exchange by primary: the join to the ids, the lists and the final rows all lie by it.
    kept = [*by, "pid", "asked", "v"]
    if with_one_hop:
        # Every immediate neighbour in either direction as 'Label:id'
        named, kept = named.withColumn("nb", F.concat_ws(":", "olabel", "oid")), [*kept, "nb"]
    named = named.select(*kept)
    if not few:
        # (a semi join would be moved below the names, which is an exchange more)
        named = named.join(exchanged(pids), [*by, "pid"])

    aggs = [F.array_sort(F.collect_set(F.when(F.col("asked").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.col("v")))).alias(col)
            for i, col in enumerate(relations)]
    if with_one_hop:
        aggs.append(F.array_sort(F.collect_set("nb")).alias("neighbours"))
    cols = list(relations) + (["neighbours"] if with_one_hop else [])
    # G9 and G11 are settled on narrow rows, so the lists are not exchanged again.
    asking = issues.select(issue_id).distinct()
    rows = prim.select(issue_id, *by, "pid", "pname").join(exchanged(asking), issue_id, "left_semi")
    if limit is not None:
        # The query's limit parameter, as a rank per issue (primary id order).
        rows = top_k(rows.withColumn("_neg", F.lit(0)), [issue_id], "_neg", ["pid"], limit, "_r").drop("_neg", "_r")
    out = rows
    if aggs:
        out = rows.join(exchanged(named.groupBy(*by, "pid").agg(*aggs)), [*by, "pid"], "left")
    out = out.select(issue_id, F.col("pid").alias("id"), F.col("pname").alias("name"), *[F.coalesce(F.col(c), _empty()).alias(c) for c in cols])
    # Every issue appears, with empty lists when nothing matched.
    null = F.lit(None).cast("string")
    alone = asking.join(exchanged(prim.select(issue_id)), issue_id, "left_anti")
    return out.unionByName(alone.select(issue_id, null.alias("id"), null.alias("name"), *[_empty().alias(c) for c in cols]))


# Neighbours a page of ``neighbour_pages``.
PAGE = 1_000
# Edges a range of ``neighbour_pages``: what one task sorts, whatever the table's size.
RANGE_EDGES = 250_000


def neighbour_pages(pids: DataFrame, edges: DataFrame, *, page: int = PAGE, by: Sequence[str] = ()) -> DataFrame:
    """G2 + G6 + G10 for nodes of any degree: (by..., label, pid, rel, dir, page, n, vals), pages of sorted distinct neighbours.

    ``pids``: (by..., label, pid).  Every page but a list's last holds ``page`` values 'Label:id'.  Edges are sorted by
    ranges of the whole (primary, relation, neighbour) key, as many as the edges need, so a hub's list is spread over
    tasks; equal ones meet in one range and are dropped there.  Places follow from a row's place in its range and the
    ranges' counts, so no task or row holds a list.
    """
    by = list(by)
    key = [*by, "label", "pid", "rel", "dir"]
    out_e = edges.select(*by, F.col("src_label").alias("label"), F.col("src_id").alias("pid"), "rel", F.lit("out").alias("dir"),
                         F.concat_ws(":", "dst_label", "dst_id").alias("v"))
    in_e = edges.select(*by, F.col("dst_label").alias("label"), F.col("dst_id").alias("pid"), "rel", F.lit("in").alias("dir"),
                        F.concat_ws(":", "src_label", "src_id").alias("v"))
    wanted = pids.select(*by, "label", "pid").distinct()
    few = fits_bytes(wanted, [*by, "label", "pid"], max_bytes=FEW_BYTES)
    touch = out_e.unionByName(in_e).join(F.broadcast(wanted) if few else exchanged(wanted), [*by, "label", "pid"], "left_semi")
    order = [*key, "v"]
    n = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-touch.count() // RANGE_EDGES))
    # Checkpointed, so a value's range and place are the same in the count and in the pages.
    ranged = cut_lineage(touch.repartitionByRange(n, *order).distinct().sortWithinPartitions(*order)
                         .withColumn("_at", F.monotonically_increasing_id())
                         .select(*order, F.shiftright("_at", 33).cast("int").alias("range"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("i")))
    ranges = ranged.groupBy(*key, "range").agg(F.count("*").alias("held"), F.min("i").alias("start"))
    upto = Window.partitionBy(*key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)     # at most a row a range
    first = cut_lineage(ranges.select(*key, "range", (F.coalesce(F.sum("held").over(upto), F.lit(0)) - F.col("start")).alias("first")))
    sent = F.broadcast(first) if fits_bytes(first, key, max_bytes=FEW_BYTES) else exchanged(first)
    placed = ranged.join(sent, [*key, "range"]).withColumn("at", F.col("first") + F.col("i"))
    # Dealt to as many tasks as there are ranges: a task holds a few hundred pages.
    dealt = placed.withColumn("page", F.floor(F.col("at") / page).cast("int")).repartition(n, *key, "page")
    return (dealt.groupBy(*key, "page")
            .agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias("vals")))


# Operators of a predicate row; the value of ``within`` is a folder: the node's path is it or lies below it.
EQUALS, WITHIN = "=", "within"


def filtered_nodes(nodes: DataFrame, predicates: DataFrame, *, issue_id: str, by: Sequence[str] = ()) -> DataFrame:
    """(issue_id, by..., label, id) of the nodes that meet all of an issue's predicates.

    ``nodes``: (by..., label, id, props map<string,string>); ``predicates``: (issue_id, by..., property, operator, value).
    ``label`` and ``id`` are properties too; a repeated node has the properties of all its rows.  An issue without predicates
    matches nothing; a predicate of another operator raises ValueError where it is a literal of the plan's rows, i.e. fails the job.

    Predicates are rows, so any number of issues is one equi join: an issue is joined to the nodes that meet the one of its
    predicates that the fewest node rows meet (equality on (property, value), ``within`` on a property's ancestor folders),
    and the others are judged on the joined row.  So predicates that most nodes meet make no rows.
    """
    by = list(by)
    p = predicates.select(issue_id, *by, "property", "operator", "value").distinct()
    known = F.col("operator").isin(EQUALS, WITHIN)
    p = p.where(F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown predicate operator: "), F.col("operator"))).cast("boolean")))
    p = cut_lineage(p)
    small = fits_bytes(p, [*by, "property", "value"], max_bytes=FEW_BYTES)

    def sent(d: DataFrame) -> DataFrame:
        return F.broadcast(d) if small else exchanged(d)

    # Only properties that a predicate names leave a node: their names are a few of the schema's.
    names = p.agg(F.collect_set("property").alias("names"), F.collect_set(F.when(F.col("operator") == WITHIN, F.col("property"))).alias("paths"))
    own = F.map_concat(F.map_filter("props", lambda k, v: ~k.isin("label", "id")), F.create_map(F.lit("label"), F.col("label"), F.lit("id"), F.col("id")))
    held = F.filter(F.map_entries(own), lambda e: F.array_contains("names", e["key"]) & e["value"].isNotNull())
    named = nodes.withColumns({"names": names.select("names").scalar(), "paths": names.select("paths").scalar()})
    narrow = named.select(*by, "label", "id", "paths", held.alias("held"))

    def met(d: DataFrame) -> DataFrame:
        """``d`` with what its rows meet: (property, operator, value) for every property, and for every folder above a path."""
        exact = F.transform("held", lambda e: F.struct(e["key"].alias("property"), F.lit(EQUALS).alias("operator"), e["value"].alias("value")))
        folders = lambda v: F.transform(F.sequence(F.lit(1), F.size(F.split(v, "/"))), lambda k: F.array_join(F.slice(F.split(v, "/"), 1, k), "/"))
        above = F.flatten(F.transform(F.filter("held", lambda e: F.array_contains("paths", e["key"])), lambda e: F.transform(
            folders(e["value"]), lambda v: F.struct(e["key"].alias("property"), F.lit(WITHIN).alias("operator"), v.alias("value")))))
        return d.select(*[c for c in d.columns if c != "paths"], F.inline(F.array_distinct(F.concat(exact, above))))

    rule = [*by, "property", "operator", "value"]
    rules = p.select(*rule).distinct()
    counts = met(narrow).join(sent(rules), rule).groupBy(*rule).agg(F.count("*").alias("n"))
    # A rule that no node meets counts 0 and is then its issue's rarest, which gives no rows.
    rarest = F.min_by(F.struct("property", "operator", "value"), F.struct(F.coalesce("n", F.lit(0)), "property", "operator", "value"))
    asked = (p.join(exchanged(counts), rule, "left").groupBy(issue_id, *by)
             .agg(F.collect_list(F.struct("property", "operator", "value")).alias("all"), rarest.alias("r"))
             .select(issue_id, *by, "r.property", "r.operator", "r.value", "all").where(F.col(issue_id).isNotNull()))
    # Rows of one node are one: its properties' distinct values.
    once = narrow.groupBy(*by, "label", "id").agg(F.first("paths").alias("paths"), F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    found = met(once).join(sent(cut_lineage(asked)), rule)

    def holds(x):
        return F.exists("held", lambda e: (e["key"] == x["property"]) & F.when(x["operator"] == EQUALS, e["value"] == x["value"])
                        .otherwise((e["value"] == x["value"]) | F.startswith(e["value"], F.concat(x["value"], F.lit("/")))))
    return found.where(F.forall("all", lambda x: F.coalesce(holds(x), F.lit(False)))).select(issue_id, *by, "label", "id")


def results_per_issue(rows: DataFrame, issue_id: str, fields: list[str]) -> DataFrame:
    """One list of maps per issue, sorted by primary id for determinism."""
    item = F.struct(*[F.col(f) for f in ["id", "name", *fields]])
    return (rows.filter(F.col("id").isNotNull())
            .groupBy(issue_id)
            .agg(F.array_sort(F.collect_list(item)).alias("results")))
