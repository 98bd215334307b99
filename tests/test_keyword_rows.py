"""Keyword scores are made where a document's row lies; repeated and null ids, collections, chunks of queries."""

import collections
import math
import re

import pytest

from codeloom.operators import hybrid as H
from codeloom.operators import keyword
from codeloom.operators.keyword import bm25, bm25_fields, bm25f

DOCS = [(1, "Red fox", "red fox, red; Éa 7"), (1, "Red fox", "red fox, red; Éa 7"), (1, "x", "fox"), (2, None, "blue"), (3, "", None), (None, "red", "red sea"),
        (4, "sea", "   "), (5, "the sea", "the red sea the end éa")]
QUERIES = [(10, "red red sea"), (11, "ÉA 7 the"), (12, "nothing"), (13, ""), (None, "fox")]


def _tokens(t):
    return [w for w in re.split(r"[^a-zé0-9]+", (t or "").lower()) if w]


def _want(fields, mode):
    """Rows of one id and like lengths are one document, as postings of it are told apart by nothing else."""
    rows = collections.defaultdict(lambda: [collections.Counter() for _ in fields])
    for doc, title, text in DOCS:
        toks = [_tokens({"title": title, "text": text}[f]) for f in fields]
        for c, t in zip(rows[doc, tuple(map(len, toks))], toks, strict=True):
            c.update(t)
    n = len(rows)
    avg = [sum(dl[i] for _, dl in rows) / n for i in range(len(fields))]
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    out = collections.Counter()
    for q, text in QUERIES:
        for t, qtf in collections.Counter(_tokens(text)).items():
            df = sum(any(c[t] for c in cs) for cs in rows.values())
            dfs = [sum(cs[i][t] > 0 for cs in rows.values()) for i in range(len(fields))]
            for (doc, dl), cs in rows.items():
                if any(c[t] for c in cs):
                    xs = [cs[i][t] / (0.25 + 0.75 * dl[i] / avg[i]) for i in range(len(fields))]
                    if mode == "f":
                        x = sum(w * y for w, y in zip(fields.values(), xs, strict=True))
                        out[q, doc] += qtf * idf(df) * x * 2.2 / (x + 1.2)
                    else:
                        out[q, doc] += sum(qtf * w * idf(d) * y * 2.2 / (y + 1.2) for w, d, y in zip(fields.values(), dfs, xs, strict=True))
    return out


def _frames(spark):
    return (spark.createDataFrame(DOCS, "doc_id long, title string, text string").repartition(3),
            spark.createDataFrame(QUERIES, "query_id long, text string"))


@pytest.mark.parametrize("limit", [keyword.QUERY_BYTES, 120])
@pytest.mark.parametrize("cells", [1 << 20, 3])
def test_repeated_and_null_ids(spark, monkeypatch, limit, cells):
    monkeypatch.setattr(keyword, "QUERY_BYTES", limit)
    monkeypatch.setattr(keyword, "_CELLS", cells)
    docs, queries = _frames(spark)
    for scores, fields, mode in ((bm25f, {"title": 2.0, "text": 1.0}, "f"), (bm25_fields, {"title": 2.0, "text": 1.0}, "sum"), (bm25f, {"text": 1.0}, "f")):
        got = {(r.query_id, r.doc_id): r.kw_score for r in scores(docs, queries, fields).collect()}
        want = _want(fields, mode)
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_are_made_without_an_exchange(spark):
    docs, queries = _frames(spark)
    plan = bm25(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_keyword_only_pairs_are_not_exchanged(spark):
    docs, queries = _frames(spark)
    plan = H.hybrid(docs, queries)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_leg_ranks_are_counted_once(spark, monkeypatch):
    """The vector ranks are counted for checkpointed hits, not on top of the keyword ranks."""
    seen = []
    ranks = H.vector_ranks

    def watched(dv, qv, hits, **kw):
        seen.append(hits._jdf.queryExecution().executedPlan().toString())
        return ranks(dv, qv, hits, **kw)
    monkeypatch.setattr(H, "vector_ranks", watched)
    docs = spark.createDataFrame([(i, f"a b c{i % 3}") for i in range(20)], "doc_id long, text string")
    vec = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(20)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(3, "a c1")], "query_id long, text string")
    rows = H.hybrid(docs, queries, doc_vectors=vec, query_vectors=vec, ranks=True).collect()
    assert len(rows) == 10 and len(seen) == 1 and "Join" not in seen[0]


@pytest.mark.parametrize("parts", [1, 16])
def test_keyword_only_hits_with_scores_that_rounding_ties(spark, monkeypatch, parts):
    """Documents below the bound of the groups' best scores are left out before the sort; ties by rounding still go to the smaller id."""
    monkeypatch.setattr(H, "PARTS", parts)
    docs = spark.createDataFrame([(i, "w") for i in range(1)], "doc_id long, text string")
    queries = spark.createDataFrame([(7, "w")], "query_id long, text string")
    # scores 1e-6 apart over a range of 10: scaled, ten of them round to one
    rows = [(7, 5000 - i, 10.0 - i * 1e-6) for i in range(300)] + [(7, i, float(i % 9)) for i in range(2000)] + [(8, 1, 2.0)]
    kw = spark.createDataFrame(rows, "query_id long, doc_id long, kw_score double").repartition(4)
    monkeypatch.setattr(H, "bm25f", lambda *a, **k: kw)
    top = []
    sort = H.top_k
    monkeypatch.setattr(H, "top_k", lambda df, *a, **k: top.append(df) or sort(df, *a, **k))
    got = H.hybrid(docs, queries, k=10).collect()
    want = sorted(((round(s / 10.0, 6), d) for _, d, s in rows if _ == 7), key=lambda x: (-x[0], x[1]))[:10]
    assert [(r.score, r.doc_id) for r in sorted((r for r in got if r.query_id == 7), key=lambda r: r["rank"])] == want
    assert [(r.doc_id, r.score) for r in got if r.query_id == 8] == [(1, 1.0)]
    assert parts == 1 or top[0].count() < 200
