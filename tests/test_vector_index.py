"""V4 vector index against the full scan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.operators.vector import vector_topk
from codeloom.operators.vector_index import VectorIndex


def _table(spark, x, ids=None, extra=None):
    rows = [(int(i if ids is None else ids[i]), [float(y) for y in v], *( [extra[i]] if extra else [])) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<float>" + (", snapshot_id string" if extra else "")).repartition(4)


def _clustered(rng, n, width=32, centres=20, spread=0.25):
    c = rng.normal(size=(centres, width))
    return c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, width))


def _rows(df):
    return sorted((r["query_id"], r["vec_rank"], r["doc_id"], round(r["vec_score"], 6)) for r in df.collect())


def _exact(docs, queries, k, **kw):
    return _rows(vector_topk(docs, queries, k, **kw)[0])


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(1)
    x = _clustered(rng, 4_000)
    x[3_000:3_600] = x[3_000]                       # copies
    x[3_700] = 0
    docs = _table(spark, x).cache()
    queries = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return docs, queries, VectorIndex.build(docs)


def test_same_rows_as_the_full_scan(clustered):
    docs, queries, index = clustered
    assert _rows(index.topk(queries, 10)) == _exact(docs, queries, 10)


def test_few_pairs_are_compared_exactly(clustered):
    docs, queries, index = clustered
    n = index.candidates(queries, 10).count()
    assert n < 0.03 * docs.count() * queries.count()


def test_few_probes_reach_the_recall_on_clustered_vectors(clustered):
    docs, queries, index = clustered
    want = _exact(docs, queries, 10)
    got = _rows(index.topk(queries, 10, probes=4))
    # Copies tie: compare scores, not ids.
    score = lambda rows: {(q, r): s for q, r, _, s in rows}
    a, b = score(want), score(got)
    assert sum(b.get(key, -2) >= s - 1e-6 for key, s in a.items()) >= 0.9 * len(a)
    lists = index.candidates(queries, 10, probes=4).groupBy("query_id").agg(F.countDistinct("list").alias("n")).agg(F.max("n")).first()[0]
    assert lists <= 4


def test_spread_vectors_odd_rows_and_chunks(spark, monkeypatch):
    from codeloom.operators import vector_index
    monkeypatch.setattr(vector_index, "CHUNK_BYTES", 2_000)
    rng = np.random.default_rng(2)
    docs = _table(spark, rng.normal(size=(600, 16)))
    odd = spark.createDataFrame([(None, [1.0] * 16), (9_000, None), (9_001, [0.0] * 16)], "doc_id long, embedding array<float>")
    queries = docs.where("doc_id < 40").select(F.col("doc_id").alias("query_id"), "embedding")
    index = VectorIndex.build(docs.unionByName(odd), lists=12)
    want = _exact(docs.unionByName(odd.where("doc_id = 9001")), queries, 7)
    assert _rows(index.topk(queries, 7)) == want
    index.drop()


def test_snapshots_are_appended_and_kept_apart(spark):
    rng = np.random.default_rng(3)
    x = _clustered(rng, 900, 16, 6)
    first = _table(spark, x[:500], extra=["a"] * 300 + ["b"] * 200)
    second = _table(spark, x[500:], ids=np.arange(500, 900), extra=["b"] * 400)
    queries = first.where("doc_id % 30 = 0").select(F.col("doc_id").alias("query_id"), "embedding", "snapshot_id")
    index = VectorIndex.build(first, by="snapshot_id")
    before = {f.path for f in _files(spark, index.path)}
    index.append(second, by="snapshot_id")
    assert before <= {f.path for f in _files(spark, index.path)}
    want = _exact(first.unionByName(second), queries, 8, group="snapshot_id")
    assert _rows(index.topk(queries, 8, by="snapshot_id")) == want


def _files(spark, path):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path").collect()


def test_an_empty_collection(spark):
    docs = spark.createDataFrame([], "doc_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert VectorIndex.build(docs).topk(queries, 3).collect() == []
