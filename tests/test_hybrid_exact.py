"""The hybrid result does not depend on the depth, the number of queries or the partitioning."""

import pytest

from codeloom.operators.hybrid import hybrid


def _tables(spark, partitions):
    docs = spark.createDataFrame([(1, "x"), (5, "y"), (9, "z")], "doc_id long, text string").repartition(partitions)
    queries = spark.createDataFrame([(7, "none of them")], "query_id long, text string")
    # cosines with (1, 0): -1.0 (id 1), 0.9 (id 5), 0.900001 (id 9); the last two fuse to one rounded score
    at = lambda c: [c, (1 - c * c) ** 0.5]
    vec = spark.createDataFrame([(1, at(-1.0)), (5, at(0.9)), (9, at(0.900001))], "vec_id long, embedding array<double>")
    qv = spark.createDataFrame([(7, [1.0, 0.0])], "vec_id long, embedding array<double>")
    return docs, queries, vec.repartition(partitions), qv


@pytest.mark.parametrize("depth", [1, 2, 256])
@pytest.mark.parametrize("partitions", [1, 3])
def test_ties_made_by_rounding_go_to_the_smaller_id(spark, depth, partitions):
    docs, queries, vec, qv = _tables(spark, partitions)
    rows = hybrid(docs, queries, doc_vectors=vec, query_vectors=qv, k=1, depth=depth).collect()
    assert [(r.doc_id, r.score) for r in rows] == [(5, 0.7)]


def test_equal_vectors_keep_the_smallest_ids(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(200)], "doc_id long, text string").repartition(4)
    queries = spark.createDataFrame([(7, "none")], "query_id long, text string")
    vec = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(200)], "vec_id long, embedding array<double>").repartition(4)
    rows = hybrid(docs, queries, doc_vectors=vec, query_vectors=vec.where("vec_id = 7"), k=5, depth=1).collect()
    assert sorted(r.doc_id for r in rows) == [0, 1, 2, 3, 4]


def test_index_leg_and_leg_ranks(spark):
    """With an index the vector leg is its ``depth`` best, scaled among themselves; ranks count either leg."""
    import numpy as np

    from codeloom.operators.keyword import bm25
    from codeloom.operators.vector import vector_topk
    from codeloom.operators.vector_index import VectorIndex
    rng = np.random.default_rng(7)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], 1 + i % 9))) for i in range(300)], "doc_id long, text string")
    queries = spark.createDataFrame([(i, t) for i, t in enumerate(["a b", "c", "zzz", "e f a"])], "query_id long, text string")
    vec = spark.createDataFrame([(i, [float(y) for y in rng.normal(size=8)]) for i in range(300)], "vec_id long, embedding array<float>")
    dv = vec.withColumnRenamed("vec_id", "doc_id")
    index = VectorIndex.build(dv)
    h = hybrid(docs, queries, query_vectors=vec, vector_index=index, depth=20, k=5, ranks=True).collect()
    kw = {}
    for r in bm25(docs, queries).collect():
        kw.setdefault(r["query_id"], {})[r["doc_id"]] = round(r["kw_score"], 6)
    qv = vec.where("vec_id < 4").withColumnRenamed("vec_id", "query_id")
    near = {}
    for r in vector_topk(dv, qv, 20)[0].collect():
        near.setdefault(r["query_id"], {})[r["doc_id"]] = r["vec_score"]
    order = lambda leg: sorted(leg, key=lambda d: (-leg[d], d))
    scale = lambda leg, d: 0.0 if d not in leg else (leg[d] - min(leg.values())) / (max(leg.values()) - min(leg.values()))
    for q in range(4):
        k, v = kw.get(q, {}), near[q]
        fused = sorted({d: round(0.7 * scale(v, d) + 0.3 * scale(k, d), 6) for d in {*k, *v}}.items(), key=lambda x: (-x[1], x[0]))[:5]
        got = sorted([r for r in h if r["query_id"] == q], key=lambda r: r["rank"])
        assert [(r["doc_id"], round(r["score"], 5)) for r in got] == [(d, round(s, 5)) for d, s in fused]
        for r in got:
            d = r["doc_id"]
            assert r["kw_rank"] == (order(k).index(d) + 1 if d in k else None)
            assert r["vec_rank"] == (order(v).index(d) + 1 if d in v else None)
