"""Stored postings against the search that reads the texts."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import postings
from codeloom.operators.keyword import bm25f
from codeloom.operators.postings import PostingsIndex
from codeloom.operators.ranking import rounded, top_k

FIELDS = {"title": 2.5, "text": 1.0}


def _docs(n=400, seed=1):
    rng = random.Random(seed)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randint(5, 200))] + [rng.choice(rare) for _ in range(rng.randint(0, 6))]
        rng.shuffle(words)
        out.append((i, " ".join(words[:3]), " ".join(words), "ab"[i % 3 == 0]))
    return out + [(n, None, None, "a"), (n + 1, "", "", "a"), (n + 2, "c1 c1", "c1", "b"), (n + 3, "c1 c1", "c1", "b"), (None, "c1", "c1", "a")]


SCHEMA = "doc_id long, title string, text string, snapshot_id string"
QUERIES = [(1, "r1 r2 c0 c1", "a"), (2, "C3 c3 r7", "b"), (3, "c0 c1 c2 c3 c4 c5", "a"), (4, "nothing here", "a"), (5, "", "b"), (6, "r9", "b")]


def _frames(spark):
    return (spark.createDataFrame(_docs(), SCHEMA).repartition(3),
            spark.createDataFrame(QUERIES, "query_id long, text string, snapshot_id string"))


def _want(docs, queries, k, by=()):
    s = bm25f(docs.where("doc_id IS NOT NULL"), queries, FIELDS, by=list(by)).withColumn("score", rounded("kw_score"))
    return _rows(top_k(s, ["query_id"], "score", ["doc_id"], k))


def _rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 5)) for r in df.collect())


@pytest.mark.parametrize("chunk", [16 << 20, 300])
def test_fields_and_collections(spark, monkeypatch, chunk):
    monkeypatch.setattr(postings, "CHUNK_BYTES", chunk)
    docs, queries = _frames(spark)
    index = PostingsIndex.build(docs, list(FIELDS), by="snapshot_id")
    got = index.topk(queries, 5, by="snapshot_id", boosts=list(FIELDS.values()))
    assert _rows(got) == _want(docs, queries, 5, ["snapshot_id"])


def test_a_second_batch_reads_no_text_and_appended_snapshots_count(spark, monkeypatch):
    docs, queries = _frames(spark)
    built = PostingsIndex.build(docs.where("doc_id < 150"), list(FIELDS))
    built.append(docs.where("doc_id >= 150"))
    index = PostingsIndex(spark, built.path, list(FIELDS))      # opened by its path: no documents at hand

    def unread(*args, **kw):
        raise AssertionError("documents are tokenized again")
    monkeypatch.setattr(postings, "term_rows", unread)
    for batch in (queries.where("query_id < 4"), queries.where("query_id >= 4")):
        assert _rows(index.topk(batch, 10, boosts=list(FIELDS.values()))) == _want(docs, batch, 10)


def test_blocks_of_common_terms_are_skipped(spark):
    docs, _ = _frames(spark)
    index = PostingsIndex.build(docs, ["text"])
    queries = spark.createDataFrame([(1, "r1 r2 r3 r4 c0 c1")], "query_id long, text string")
    skipped = []
    got = index.topk(queries, 2, skipped=skipped)
    s = bm25f(docs.where(F.col("doc_id").isNotNull()), queries, {"text": 1.0}).withColumn("score", rounded("kw_score"))
    assert _rows(got) == _rows(top_k(s, ["query_id"], "score", ["doc_id"], 2))
    (all_postings, read), = skipped
    assert read < 0.5 * all_postings


@pytest.mark.parametrize("looked_up", [0, 10**9])
def test_rows_of_one_id_and_either_way_of_scoring(spark, monkeypatch, looked_up):
    """Documents are exchanged as rows, not as terms; candidates looked up or all postings read give one result."""
    monkeypatch.setattr(postings, "LOOKED_UP", looked_up)
    docs = spark.createDataFrame([(i % 40, None, f"c{i % 3} c{i % 5} x") for i in range(120)] + [(None, None, "c1"), (7, None, None)], "doc_id long, title string, text string")
    rows = postings.term_rows(docs.where("doc_id IS NOT NULL"), list(FIELDS), "doc_id")
    assert rows.count() == 41 and rows._jdf.queryExecution().executedPlan().toString().count("Generate") == 0
    index = PostingsIndex.build(docs, list(FIELDS))
    queries = spark.createDataFrame([(1, "c1 c4 x"), (2, "C0 c3 c3")], "query_id long, text string")
    assert _rows(index.topk(queries, 6, boosts=list(FIELDS.values()))) == _want(docs, queries, 6)
