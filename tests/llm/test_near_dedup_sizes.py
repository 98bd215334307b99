"""Pairs whose sizes are in the threshold's very ratio are linked, whatever size class they fall in."""

from codeloom.llm.near_dedup import near_dedup


def test_sizes_in_the_very_ratio(spark):
    rows, want = [], {}
    for g, n in enumerate((4, 16, 40, 100, 256, 1024)):
        words = [f"w{g}x{i}" for i in range(n + 4)]
        a, b = 10 * g, 10 * g + 1
        rows += [(a, " ".join(words)), (b, " ".join(words[:n * 3 // 4 + 4])), (b + 1, " ".join(words[:n * 3 // 4 + 3]))]
        want |= {a: a, b: a}
    got = {r.doc_id: r.component_id for r in near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: got[k] for k in want} == want
