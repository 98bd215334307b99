"""C1/C2 against a stored graph, per snapshot.

Nodes and edges are stored in buckets by a hash of their key (snapshot, label and id; for edges the
ends' labels and ids and the relation).  A batch of updates reads and rewrites the buckets it touches and no
others: the new contents go to a folder of the batch's own, and a version file then names, for every
bucket, the folder that holds it.  Readers follow the newest version file, so a batch that is lost
half-way leaves the old state, and untouched buckets keep their files.

Batches are applied one after another by one writer; a batch's updates come after all stored state,
within it ``ord`` decides.  Edges are kept only if both ends are stored nodes of their snapshot; of the node
buckets only those of the edges' ends are read for that.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir
from .upsert import EDGE_KEY, NODE_KEY, upsert_edges, upsert_nodes

BUCKETS = 64
BY = ["snapshot_id"]
_NODES = "snapshot_id string, label string, id string, props map<string,string>"
_EDGES = "snapshot_id string, src_label string, src_id string, rel string, dst_label string, dst_id string, props map<string,string>"


class GraphState:
    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark, self.buckets = spark, buckets
        self.path = path or f"{ensure_checkpoint_dir(spark)}/graph-{uuid.uuid4().hex}"
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self._conf)

    def version(self) -> dict:
        """{'n': number, 'nodes': {bucket: folder}, 'edges': {bucket: folder}} of the newest version."""
        p, fs = self._at("versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        if not names:
            return {"n": 0, "nodes": {}, "edges": {}}
        stream = fs.open(self._at(f"versions/{names[-1]}")[0])
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, version: dict) -> None:
        p, fs = self._at(f"versions/{version['n']:012d}.json")
        out = fs.create(p, False)           # fails if another writer made this version
        try:
            out.write(bytearray(json.dumps(version), "utf-8"))
        finally:
            out.close()

    def _bucket(self, *key: str) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, version: dict, only: list[int] | None = None) -> DataFrame:
        folders = [f for b, f in version[kind].items() if only is None or int(b) in only]
        schema = _NODES if kind == "nodes" else _EDGES
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def nodes(self) -> DataFrame:
        return self._read("nodes", self.version())

    def edges(self) -> DataFrame:
        return self._read("edges", self.version())

    def _touched(self, bucket: Column, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(bucket.alias("b")).distinct().collect())       # at most ``buckets``

    def _rewrite(self, kind: str, version: dict, rows: DataFrame, touched: list[int], bucket: Column) -> None:
        folder = f"{self.path}/{kind}/{uuid.uuid4().hex}"
        rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        _, fs = self._at("")
        names = {b: f"{folder}/bucket={b}" for b in touched}
        kept = {b: n for b, n in names.items() if fs.exists(self._jvm.org.apache.hadoop.fs.Path(n))}
        new = {k: v for k, v in version[kind].items() if int(k) not in touched} | {str(b): n for b, n in kept.items()}
        self._commit(version | {"n": version["n"] + 1, kind: new})

    def apply_nodes(self, updates: DataFrame) -> list[int]:
        """Overlay node updates (snapshot_id, label, id, props, ord); returns the buckets rewritten."""
        version, bucket = self.version(), self._bucket(*BY, *NODE_KEY)
        updates = cut_lineage(updates.select(*BY, *NODE_KEY, "props", "ord"))
        touched = self._touched(bucket, updates)
        if touched:
            self._rewrite("nodes", version, upsert_nodes(updates, self._read("nodes", version, touched), BY), touched, bucket)
        return touched

    def apply_edges(self, updates: DataFrame) -> list[int]:
        """Overlay edge updates (snapshot_id, ends, rel, props, ord) whose ends are stored; returns the buckets rewritten."""
        version, bucket = self.version(), self._bucket(*BY, *EDGE_KEY)
        updates = cut_lineage(updates.select(*BY, *EDGE_KEY, "props", "ord"))
        ends = [updates.select(*BY, F.col(f"{x}_label").alias("label"), F.col(f"{x}_id").alias("id")) for x in ("src", "dst")]
        near = self._touched(self._bucket(*BY, *NODE_KEY), ends[0].union(ends[1]))
        touched = self._touched(bucket, updates)
        if touched:
            nodes = self._read("nodes", version, near)
            self._rewrite("edges", version, upsert_edges(updates, nodes, self._read("edges", version, touched), by=BY), touched, bucket)
        return touched
