"""Quality rules as a short-circuit cascade (operator 10).  DataFrame functions only.

Every rule is a named SQL condition that rejects a document.  On a hash sample of the
documents each rule's cost (seconds to evaluate it alone) and selectivity (share it
rejects) are measured; rules then run in falling order of rejection per cost, inside
one CASE expression, so a document stops at the first rule that rejects it.  Any order
gives the same verdict, only ``failed_rule`` (the first in the cascade) and the cost
depend on it; a caller who needs a fixed order passes ``order``.

Cases: null and empty texts have no words, count 0 everywhere and fail ``n_words``;
repeated rows are judged each by itself; an empty table gives no rows; other columns
of the input are ignored.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD, bounded_sample, pick

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SAMPLE_ROWS = 2_000


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: str          # SQL over the text column and the base counts


# Production rules beyond the base test.  Ratios are kept as integer comparisons.
RULES = (
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("dup_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("letters", "10 * length(regexp_replace(text, '[^\\\\p{L}]', '')) < 6 * word_chars"),
    Rule("capitals", "10 * length(regexp_replace(text, '[^\\\\p{Lu}]', '')) > 5 * word_chars"),
)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    One pass, row by row: nothing is shuffled, so a long or repeated document costs only its
    own length.  Repeated windows are found by 64-bit hashes; only texts that have one sort
    their windows.
    """
    d = pick(docs, doc_id="long", text="string")
    t = F.coalesce(F.col("text"), F.lit(""))
    has_word = lambda line: F.length(F.translate(line, BLANKS, "")) > 0
    d = d.select("doc_id", t.alias("text"), F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)).alias("_words"),
                 F.filter(F.split(t, "\n", -1), has_word).alias("_lines"))
    n = F.size("_words")
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                         lambda i: F.xxhash64(*[F.element_at("_words", i + j) for j in range(WINDOW)]))
    d = d.select("doc_id", "text", n.cast("long").alias("n_words"),
                 F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
                 (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.size("_lines").cast("long").alias("n_lines"),
                 (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                 F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    # Texts with a repeated window: (hash, start) pairs in hash order, kept where a neighbour has the same hash.
    repeated = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.withColumn("_s", F.when(repeated, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, i: ((F.try_element_at("_s", i + 2)["h"] == x["h"])
                         | F.coalesce(F.when(i > 0, F.try_element_at("_s", F.when(i > 0, i).otherwise(F.lit(1)))["h"] == x["h"]), F.lit(False)))
    d = d.withColumn("_at", F.sort_array(F.transform(F.filter("_s", lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))
    # Words covered by the starts: each start adds the words before the next start, at most a window.
    added = F.transform("_at", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.try_element_at("_at", i + 2) - x, F.lit(WINDOW))))
    covered = F.aggregate(added, F.lit(0), lambda a, x: a + x)
    return d.select("doc_id", "text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines",
                    F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _rejects(rule: Rule) -> Column:
    return F.coalesce(F.expr(rule.rejects), F.lit(False))


def measure(counted: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds, share rejected) on a hash sample of about ``sample_rows`` rows.

    The sample's inputs are computed once and held; each rule is then one small job over them.
    The driver receives two numbers a rule.
    """
    held = bounded_sample(counted, F.col("doc_id"), sample_rows).persist()
    try:
        n = held.count()

        def seconds(of: list[Column]) -> tuple[float, float]:
            t0 = time.perf_counter()
            hits = held.agg(*[F.count_if(c) for c in of]).first()[0]
            return time.perf_counter() - t0, hits / max(1, n)

        idle, _ = seconds([F.lit(False)])
        out = []
        for r in rules:
            spent, share = seconds([_rejects(r)])
            out.append((r.name, max(spent - idle, 1e-4), share))
        return out
    finally:
        held.unpersist()


def plan(measured: list[tuple[str, float, float]], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """Rules by falling rejection per cost; ties keep the given order."""
    gain = {name: share / cost for name, cost, share in measured}
    return sorted(rules, key=lambda r: -gain[r.name])


def cascade(counted: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds base_failed, failed_rule (null: none) and kept; a CASE stops at the first rejecting rule."""
    case = F.when(base_failed(), F.lit("base"))
    for r in rules:
        case = case.when(_rejects(r), F.lit(r.name))
    return (counted.withColumn("base_failed", base_failed()).withColumn("failed_rule", case)
            .withColumn("kept", F.col("failed_rule").isNull()))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, order: list[str] | None = None,
                  sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, text, the counts, base_failed, failed_rule and kept for every row of ``docs``."""
    counted = base_counts(docs)
    if order is not None:
        by_name = {r.name: r for r in rules}
        ordered = [by_name[x] for x in order]
    else:
        # Sampled before the counts are computed: the sample costs its own rows only.
        sample = bounded_sample(pick(docs, doc_id="long", text="string"), F.col("doc_id"), sample_rows)
        ordered = plan(measure(base_counts(sample), rules, sample_rows), rules)
    return cascade(counted, ordered)
