"""Both legs scored where a document lies: the rows of the search by exchanged vectors, and few of them from a task."""

import random

import numpy as np
from pyspark.sql import functions as F

from codeloom.operators import fused
from codeloom.operators.hybrid import _query_vectors, hybrid
from codeloom.operators.ranking import rounded
from codeloom.operators.vector import embed

WORDS = [f"w{i}" for i in range(30)]


def made_up(spark, ties=300):
    """Documents and queries of several collections, with nulls, missing vectors and many equal rows."""
    rng = random.Random(3)
    docs = []
    for i in range(400):
        text = None if i % 97 == 0 else " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 6)))
        vec = None if i % 41 == 0 else [float(rng.randint(-2, 2)) for _ in range(4)]
        docs.append((["a", "b", "c", None][i % 4], i * 7 % 400, text, vec))
    docs += [("a", 1000 + i, "w1 w2", [1.0, 0.0, 0.0, 1.0]) for i in range(ties)]
    queries = [(["a", "b", "d"][i % 3], i, ["w1 w2 w3", "w5 w5 zz", "", "nope", None, "w1 w2"][i % 6]) for i in range(18)]
    vectors = [(i, None if i % 7 == 3 else [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(18) if i % 11]
    return (spark.createDataFrame(docs, "snap string, doc_id long, text string, e array<float>").repartition(3),
            spark.createDataFrame(queries, "snap string, query_id long, text string"), spark.createDataFrame(vectors, "vec_id long, embedding array<float>"))


def test_documents_with_vectors_give_the_rows_of_the_joined_search(spark):
    docs, queries, vectors = made_up(spark)
    own = docs.select(F.col("doc_id").alias("vec_id"), F.col("e").alias("embedding"))
    rows = lambda d: sorted((tuple(r) for r in d.collect()), key=str)
    for by in ("snap", None):
        want = rows(hybrid(docs, queries, doc_vectors=own, query_vectors=vectors, by=by, k=5))
        assert len(want) > 20 and rows(hybrid(docs, queries, doc_vec="e", query_vectors=vectors, by=by, k=5)) == want


def test_tied_documents_leave_a_task_as_k_rows_a_query(spark, monkeypatch):
    docs, queries, vectors = made_up(spark, ties=3_000)
    qv = _query_vectors(queries, vectors, "query_id", "vec_id", "embedding", ["snap"])
    found = fused.candidates(docs, queries, qv, {"text": 1.0}, doc_id="doc_id", doc_vec="e", query_id="query_id", query_text="text", by=["snap"], alpha=0.7, k=5)
    sizes = found.groupBy(F.spark_partition_id(), "query_id").count().select("count").collect()
    assert max(r[0] for r in sizes) == 5
    whole = {tuple(r) for r in found.collect()}
    monkeypatch.setattr(fused, "chunks_of", lambda qt, by: 3)      # queries in several parts
    parts = fused.candidates(docs, queries, qv, {"text": 1.0}, doc_id="doc_id", doc_vec="e", query_id="query_id", query_text="text", by=["snap"], alpha=0.7, k=5)
    assert len(parts.inputFiles()) == 0 and {r["query_id"] for r in parts.collect()} == {r[0] for r in whole}


def test_half_up_is_sparks_rounding(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 3, 2_000), np.round(rng.normal(0, 3, 2_000), 6) + 5e-7, np.arange(-50, 50) / 1e6 + 5e-7, [0.0, 0.1234565, -0.1234565, 1e9 + 0.5]])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", rounded("x").alias("r")).collect()
    assert fused.half_up(np.array([r["x"] for r in rows])).tolist() == [r["r"] for r in rows]


def test_best_keeps_the_smallest_ids_of_ties_a_null_id_first():
    best = fused._Best(2, 2)
    for lo in range(0, 40, 10):
        doc = np.arange(lo, lo + 10)[::-1]
        zero, yes = np.zeros(10), np.ones(10, dtype=bool)
        best.add(np.arange(10) % 2, np.ones(10), doc, doc == 21, zero, yes, zero, yes)
        best.keep()
    q, _, doc, null, *_ = best.rows[0]
    assert sorted(zip(q.tolist(), doc.tolist(), null.tolist(), strict=True)) == [(0, 1, False), (0, 21, True), (1, 0, False), (1, 2, False)]


def test_vectors_come_in_batches_of_the_models_size(spark):
    def model():
        return lambda texts: np.array([[len(texts), -1.0 if t is None else len(t)] for t in texts])
    rows = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(150)], "i long, text string").coalesce(1)
    got = {r["i"]: r["embedding"] for r in embed(rows, model=model, batch_size=64).collect()}
    assert [got[i][0] for i in (0, 63, 64, 127, 128, 149)] == [64, 64, 64, 64, 22, 22]
    assert got[3][1] == -1.0 and all(got[i][1] == i for i in range(150) if i != 3)
