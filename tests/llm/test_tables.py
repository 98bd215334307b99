"""URL filter, exact top-k, the pipeline and the registered queries."""

import collections
import math
import os
import random

import numpy as np
import pytest

import fixtures as X
from codeloom.llm import exact_topk, url_filter


# --- operator 6 ---

URLS = [
    "https://example.org/es/x", "https://a.example.org/en/1?q", "https://EXAMPLE.org/en/2", "https://example.org", "http://notexample.org/es/",
    "https://fr.site.com/fr/a", "https://site.com/de/#top", "https://site.com/it/", "https://site.com/FR/a", "no scheme", None, "", "x://", "://h/p",
    "https://org/", "https://a.b.org/p://q", "https://site.com/de/", "https://site.com/de/", "https://other.net/zz"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    want = {0: ("example.org", "/es/x", "example.org/es/"), 1: ("a.example.org", "/en/1", "example.org/en/1"), 2: ("example.org", "/en/2", "org/"),
            3: ("example.org", "", None), 4: ("notexample.org", "/es/", "org/"), 5: ("fr.site.com", "/fr/a", "com/fr/"), 6: ("site.com", "/de/", "com/de/"),
            7: ("site.com", "/it/", None), 8: ("site.com", "/FR/a", None), 9: ("", "", None), 10: ("", "", None), 11: ("", "", None), 12: ("", "", None),
            13: ("h", "/p", None), 14: ("org", "/", "org/"), 15: ("a.b.org", "/p://q", "org/")}
    assert len(got) == len(URLS)
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule) == w
        if w[2]:
            assert got[i].verdict == ("block" if w[2] in ("example.org/es/", "example.org/en/1", "com/de/") else "allow")


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    urls = URLS + [f"https://{X.word(rng, 'en')}.{rng.choice(['example.org', 'site.com', 'x.net'])}/{rng.choice(['en', 'es', 'de', 'fr'])}/{rng.randrange(50)}" for _ in range(150)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.url_filter(pages).collect()}
    order = url_filter.ORDER
    grams = lambda u: [s[i:i + order + 1] for s in ["\x02" * order + (u or "") + "\x03"] for i in range(len(s) - order)]
    n = {v: collections.Counter() for v in ("allow", "block")}
    for i, u in enumerate(urls):
        for g in grams(u):
            if out[i].rule:
                n[out[i].verdict].update(g[-k - 1:] for k in range(order + 1))
    seen = {g[-1] for u in urls for g in grams(u)}

    def p(v, g):
        c = n[v]
        est = (c[g[-1]] + 1) / (sum(x for k, x in c.items() if len(k) == 1) + len(seen))
        for k in range(1, order + 1):
            follow = {x: m for x, m in c.items() if len(x) == k + 1 and x[:-1] == g[-k - 1:-1]}
            if follow:
                est = (c[g[-k - 1:]] + len(follow) * est) / (sum(follow.values()) + len(follow))
        return est
    for i in range(0, len(urls), 9):
        want = np.mean([math.log(p("allow", g)) - math.log(p("block", g)) for g in grams(urls[i])])
        assert math.isclose(out[i].score, want, abs_tol=1e-9)
    free = [r for r in out.values() if r.rule is None]
    assert min([r.score for r in free if r.verdict == "allow"], default=9) >= max([r.score for r in free if r.verdict == "block"], default=-9)


def test_urls_without_both_classes(spark):
    pages = spark.createDataFrame([(1, "https://a.net/x"), (2, None)], "page_id long, url string")
    assert {(r.verdict, r.score) for r in url_filter.url_filter(pages).collect()} == {("allow", 0.0)}
    assert url_filter.url_filter(spark.createDataFrame([], "page_id long, url string")).collect() == []


# --- operator 8 ---

def brute(rows, k):
    use = {(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = {}
    for q, a in use:
        if q % 20 == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in use if i != q))[:k]
            out.setdefault(q, []).append([(i, -x) for x, i in s])
    return out


@pytest.mark.parametrize("block", [(16_384, 2_048), (40, 3)])
def test_topk_equals_brute_force(spark, block):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)]) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(60)]                       # ties
    rows += [(400, [0.0] * 8), (420, []), (440, [1e6] * 8), (441, [-1e6] * 7), (460, None), (461, [None] * 8), (480, [float("nan")] * 8),
             (481, [float("inf")] * 8), (None, [1.0] * 8), (3, rows[3][1]), (20, rows[20][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, v int").repartition(5)
    v = exact_topk.quantised(df)
    got = collections.defaultdict(list)
    for r in exact_topk.exact_topk(v, v.where("vec_id % 20 = 0"), 20, *block).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == {q: x[0] for q, x in brute(rows, 20).items()}


def test_topk_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    centres = rng.integers(-30, 30, (10, 16))
    v = centres[rng.integers(0, 10, 4_000)] + rng.integers(-2, 3, (4_000, 16))
    ids, q = np.arange(4_000), v[:40]
    a, b, s = exact_topk.nra(np.full(40, -1), q, ids, v, 5, depths=(0.1, 0.3))
    full = q @ v.T
    for i in range(40):
        want = sorted(range(4_000), key=lambda j: (-full[i, j], j))[:5]
        assert b[a == i].tolist() == want and s[a == i].tolist() == full[i, want].tolist()


def test_topk_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [0.5]), (1, [0.25])], "vec_id long, embedding array<float>")
    v = exact_topk.quantised(df)
    assert [tuple(r) for r in exact_topk.exact_topk(v, v.where("vec_id = 0")).collect()] == [(0, 1, 1, 512)]
    assert exact_topk.exact_topk(v.limit(0), v.limit(0)).collect() == []


# --- pipeline and queries ---

def test_pipeline_equals_brute_force(spark, scratch):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P
    from test_text_operators import groups, kept_words, words
    data = X.rows(n=80)
    from codeloom.llm.common import pick
    pick(X.frame(spark, data), doc_id="long", text="string", lang="string", source="string", n_chars="long").write.parquet(f"{scratch}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "repeated_phrases", "mixing", "bpe"]
    docs, got = spark.read.parquet(f"{scratch}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, docs, scratch)
        got.append([r.asDict() for r in docs.collect()])
        if "n_chars" in docs.columns:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r["n_chars"] == len(r["text"]) for r in got[-1])
    by_id = {i: (i, t, lang, s) for i, t, lang, s in data}
    letters = {i for i, t, *_ in data if any(c.isalpha() for c in t or "")}
    first = {r["doc_id"] for r in got[0]}
    assert first <= letters and {i for i in letters if len(words(by_id[i][1])) >= 10} <= first       # clean documents stay
    kept = [by_id[i] for i in sorted(first)]
    want = groups(kept)
    second = sorted(r["doc_id"] for r in got[1])
    assert second == sorted(i for i in first if want[i] == i)
    third = {r["doc_id"]: words(r["text"]) for r in got[2]}
    assert third == {i: k for i, _, _, k in kept_words([by_id[i] for i in second])}
    total = sum(map(len, third.values()))
    assert abs(sum(len(words(r["text"])) for r in got[3]) - total) <= len({r["source"] for r in got[2]})
    assert len(got[4]) == len(got[3]) and all(r["round_trip"] and 4 * r["n_tokens"] == len(r["ids"]) for r in got[4])


def test_language_stage_without_a_learned_language(spark, scratch):
    import corpus_pipeline as P
    held = next(i for i in range(1, 99) if __import__("zlib").crc32(str(i).encode()) % 4 == 2)
    data = [(1000, "some clean words", None, "s"), (None, "É", None, None), (held, "held out text", "en", "s"), (1002, "12 -- 34", None, "s"), (1003, None, None, "s")]
    for extra in ([], [(next(i for i in range(100, 199) if __import__("zlib").crc32(str(i).encode()) % 4 != 2), "12", "en", "s")]):
        out = P.identify_language(spark, X.frame(spark, data + extra), scratch).collect()
        assert sorted((r.doc_id or -1, r.text, r.lang or "") for r in out) == sorted([(1000, "some clean words", ""), (-1, "É", ""), (held, "held out text", "en")])


def test_near_dedup_stage_keeps_unrelated_texts_of_an_id(spark, scratch):
    import corpus_pipeline as P
    rng = random.Random(31)
    a, b, c, d = (X.sentence(rng, "en", 60) for _ in range(4))
    data = [(3, a, "en", "s"), (5, a + " x", "en", "s"), (5, b, "en", "s"), (6, c, "en", "s"), (6, d, "en", "s"), (6, d, "en", "s"),
            *[(None, t, "en", "s") for t in (a, "null " + c, "y z " + a, *["own " * 30 + X.word(rng, "de")] * 4)], (None, None, None, None)]
    out = P.drop_near_duplicates(spark, X.frame(spark, data), scratch).collect()
    assert sorted(((r.doc_id or -1, r.text or "") for r in out)) == sorted([(3, a), (5, b), (6, c), (6, d), (-1, data[-2][1]), (-1, "")])


def test_queries_are_registered():
    import __spark_entry__ as E
    names = [q for q in E.queries() if q.startswith("op") or q == "pipeline"]
    assert sorted(int(q[2:].split("_")[0]) for q in names if q != "pipeline") == list(range(1, 11)) and "pipeline" in names


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("key", ["op2_repeated_phrases", "op4_near_dedup", "op5_mixing", "op8_exact_topk", "op10_quality_rules"])
def test_matches_sql(spark, key):
    import __spark_entry__ as E
    import compare
    con = compare.duck(SF)
    df = E.queries()[key](spark, SF)
    res = con.execute(E.oracle_sql()[key])
    assert compare.rows_of(df.columns, [tuple(r) for r in df.collect()]) == compare.rows_of([d[0] for d in res.description], res.fetchall())
