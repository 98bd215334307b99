"""C1/C2/C20 property-graph upserts and S7 detach delete, as aggregations.

Node updates: (label, id, props map<string,string>, ord).  MERGE semantics:
a node is created on first sight, every update overlays its properties, the
latest ``ord`` wins per property, and a null value removes the property.
Edge updates: (src_label, src_id, rel, dst_label, dst_id, props, ord); an
edge is kept only if both end nodes exist, at most one per 6-column key.

No row-wise MERGE: updates explode to (key, prop) rows, a partial
aggregation picks the latest value per property (so a hot node is combined
map-side), and a second small aggregation reassembles the property map.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.observation import Observation


NODE_KEY = ["label", "id"]
EDGE_KEY = ["src_label", "src_id", "rel", "dst_label", "dst_id"]
# Stored state sorts before any update.
STATE_ORD = -1


def _overlay(updates: DataFrame, key: Sequence[str]) -> DataFrame:
    key = list(key)
    # explode_outer keeps updates with an empty map, so such nodes still exist.
    latest = (updates
              .select(*key, "ord", F.explode_outer("props").alias("prop", "value"))
              .groupBy(*key, "prop")
              .agg(F.max_by(F.struct("value"), "ord").getField("value").alias("value")))
    entries = F.filter(F.collect_list(F.struct("prop", "value")),
                       lambda e: e.getField("prop").isNotNull() & e.getField("value").isNotNull())
    return latest.groupBy(*key).agg(F.map_from_entries(F.array_sort(entries)).alias("props"))


def _lowest_ord(dtype: T.DataType):
    """An ordering value below every update: -1, or a struct of nulls (nulls sort first)."""
    if isinstance(dtype, T.StructType):
        return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in dtype.fields])
    return F.lit(STATE_ORD).cast(dtype)


def _with_state(updates: DataFrame, state: DataFrame | None, key: Sequence[str]) -> DataFrame:
    if state is None:
        return updates
    s = state.select(*key, "props", _lowest_ord(updates.schema["ord"].dataType).alias("ord"))
    return s.unionByName(updates.select(*key, "props", "ord"))


def upsert_nodes(updates: DataFrame, state: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by..., label, id, props) after applying ``updates`` on top of ``state``; ``by`` (e.g. snapshot_id) keeps graphs apart."""
    key = [*by, *NODE_KEY]
    return _overlay(_with_state(updates, state, key), key)


class EdgeReport:
    """Counts of a C20 endpoint check, observed by the job that consumes the edges."""

    def __init__(self, name: str = "edges"):
        self.seen = Observation(f"{name}_seen")
        self.kept = Observation(f"{name}_kept")

    @property
    def dropped(self) -> int:
        """Edges silently not created because an end is missing (after an action)."""
        return int(self.seen.get["rows"]) - int(self.kept.get["rows"])


def endpoints_exist(edges: DataFrame, nodes: DataFrame, report: EdgeReport | None = None, by: Sequence[str] = ()) -> DataFrame:
    """C20: keep edges whose source and target nodes both exist (label aware, within one ``by``).

    With ``report``, the numbers of edges seen and kept are observed in the
    same job (no extra pass); ``report.dropped`` is available after an action."""
    n = nodes.select(*by, "label", "id").distinct()
    src = n.select(*by, F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    dst = n.select(*by, F.col("label").alias("dst_label"), F.col("id").alias("dst_id"))
    if report is not None:
        edges = edges.observe(report.seen, F.count(F.lit(1)).alias("rows"))
    kept = (edges.join(src, [*by, "src_label", "src_id"], "left_semi")
            .join(dst, [*by, "dst_label", "dst_id"], "left_semi"))
    if report is not None:
        kept = kept.observe(report.kept, F.count(F.lit(1)).alias("rows"))
    return kept


def upsert_edges(updates: DataFrame, nodes: DataFrame, state: DataFrame | None = None,
                 report: EdgeReport | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Edges whose ends exist, overlaid like nodes on the 5-column key + label pair."""
    key = [*by, *EDGE_KEY]
    checked = endpoints_exist(updates, nodes, report, by)
    return _overlay(_with_state(checked, state, key), key)


def flatten_props(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per (key, prop, value), for reports and comparisons."""
    return df.select(*key, F.explode("props").alias("prop", "value"))


def detach_delete(nodes: DataFrame, edges: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove ``doomed`` (label, id) nodes and every edge touching them (two anti joins)."""
    d = doomed.select("label", "id").distinct()
    kept_nodes = nodes.join(d, ["label", "id"], "left_anti").select(*nodes.columns)
    ds = d.select(F.col("label").alias("src_label"), F.col("id").alias("src_id"))
    dd = d.select(F.col("label").alias("dst_label"), F.col("id").alias("dst_id"))
    kept_edges = (edges.join(ds, ["src_label", "src_id"], "left_anti")
                  .join(dd, ["dst_label", "dst_id"], "left_anti")
                  .select(*edges.columns))
    return kept_nodes, kept_edges
