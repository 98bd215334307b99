"""URL filter by a character language-model ratio (operator 6).  DataFrame functions only.

Allow and block rules (host suffix and path prefix, longest wins) label part of the URLs.
Two variable-order Markov models over characters, one of the accepted and one of the
rejected URLs, are counted over all labelled URLs.  The probability of a character after its
ORDER predecessors backs off smoothly (Witten-Bell): the estimate at each order is the count
plus the number of different successors times the next lower order's estimate.  A URL's
score is the mean over its characters of log P(accepted) - log P(rejected); URLs without a
rule are blocked below the threshold, which lies between the two classes' mean scores in the
ratio of their spreads.

Model tables are keyed by the distinct (ORDER + 1)-grams of all URLs; every count is an
aggregate with partial sums, and the score is one join of the URLs' grams with that table on
the gram, where Spark may split a frequent gram.

Cases: a null URL, or one without ``://``, has empty host and path and no rule, and its text
(null: empty) is scored like any other, by its end alone; without accepted or
without rejected URLs every score is 0.0 and the threshold 0.0, so unruled URLs are allowed;
repeated rows are judged each by itself (they count each time); other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, staged

ORDER = 4
START = "\x02"
END = "\x03"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    pattern: str      # host suffix, then the path prefix from its first slash on


RULES = (UrlRule("allow", "org/"), UrlRule("block", "example.org/es/"), UrlRule("block", "example.org/en/1"),
         UrlRule("allow", "com/fr/"), UrlRule("block", "com/de/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """(pattern, verdict) of the longest fitting rule, null where none fits; of equal lengths the first in the list."""
    pattern = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.pattern)):
        at = r.pattern.index("/")
        suffix, prefix = r.pattern[:at], r.pattern[at:]
        fits = ((host == suffix) | F.endswith(host, F.lit("." + suffix))) & F.startswith(path, F.lit(prefix))
        pattern = F.when(fits, r.pattern) if pattern is None else pattern.when(fits, r.pattern)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (pattern, verdict) if pattern is not None else (F.lit(None).cast("string"),) * 2


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """One row a character: ``gram`` is the character after its ORDER predecessors (padded at the start, END last)."""
    padded = F.concat(F.lit(START * ORDER), F.coalesce(F.col("url"), F.lit("")), F.lit(END))
    return (urls.select(*keep, padded.alias("_p"))
            .select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("_p") - ORDER),
                                                 lambda i: F.substring(F.col("_p"), i, F.lit(ORDER + 1)))).alias("gram")))


def model(grams: DataFrame) -> DataFrame:
    """gram -> llr from (gram, accepted, rejected) counts of all distinct grams.

    Order k uses the last k characters before the predicted one; each step joins the grams
    with the counts of their shorter forms.  Everything here has a row a distinct gram at most.
    """
    out = grams.select("gram")
    shortest = grams.groupBy(F.right("gram", F.lit(1)).alias("g")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
    total = shortest.agg(*[F.sum(c).alias(f"t_{c}") for c in ("accepted", "rejected")], F.count("*").alias("v"))
    n = {c: total.select(c).scalar() for c in total.columns}
    p0 = shortest.select("g", *[((F.col(c) + 1) / (n[f"t_{c}"] + n["v"])).alias(f"p_{c}") for c in ("accepted", "rejected")])
    out = out.withColumn("g", F.right("gram", F.lit(1))).join(p0, "g").drop("g")
    for k in range(1, ORDER + 1):
        own = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("g")).agg(F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"))
        context = own.groupBy(F.left("g", F.lit(k)).alias("h")).agg(
            *[F.sum(c).alias(f"n_{c}") for c in ("accepted", "rejected")],
            *[F.count_if(F.col(c) > 0).alias(f"d_{c}") for c in ("accepted", "rejected")])
        step = own.withColumn("h", F.left("g", F.lit(k))).join(context, "h")
        smoothed = [F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"d_{c}") * F.col(f"p_{c}")) / (F.col(f"n_{c}") + F.col(f"d_{c}")))
                    .otherwise(F.col(f"p_{c}")).alias(f"p_{c}") for c in ("accepted", "rejected")]
        out = out.withColumn("g", F.right("gram", F.lit(k + 1))).join(step, "g").select("gram", *smoothed)
    both = (n["t_accepted"] > 0) & (n["t_rejected"] > 0)
    return out.select("gram", F.when(both, F.log("p_accepted") - F.log("p_rejected")).otherwise(F.lit(0.0)).alias("llr"))


def url_filter(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``."""
    p = pick(pages, page_id="long", url="string")
    host, path = split_url(F.col("url"))
    pattern, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = (p.select("page_id", "url", host.alias("host"), path.alias("path"))
             .select("page_id", "url", "host", "path", pattern.alias("rule"), verdict.alias("ruled")))
    counts = (_grams(ruled, "ruled").groupBy("gram")
              .agg(F.count_if(F.col("ruled") == "allow").alias("accepted"), F.count_if(F.col("ruled") == "block").alias("rejected")))
    llr = staged(model(staged(counts, "url-grams")), "url-model")
    # One score for each distinct URL, then back to its rows: repeated URLs are scored once.
    urls = ruled.groupBy("url").agg(F.first("ruled").alias("ruled"), F.count("*").alias("n"))
    scored = (_grams(urls, "url", "ruled", "n").join(llr, "gram").groupBy("url")
              .agg(F.avg("llr").alias("score"), F.first("ruled").alias("ruled"), F.first("n").alias("n")))
    scored = staged(scored, "url-scores")
    side = lambda v: F.when(F.col("ruled") == v, F.col("score"))
    weight = lambda v: F.when(F.col("ruled") == v, F.col("n"))
    stats = scored.agg(*[f.alias(f"{name}_{v}") for v in ("allow", "block") for name, f in (
        ("n", F.sum(weight(v))), ("m", F.sum(side(v) * F.col("n")) / F.sum(weight(v))),
        ("q", F.sum(side(v) * side(v) * F.col("n")) / F.sum(weight(v))))])
    spread = lambda v: F.sqrt(F.greatest(F.col(f"q_{v}") - F.col(f"m_{v}") * F.col(f"m_{v}"), F.lit(0.0))) + 1e-9
    threshold = stats.select(F.coalesce((F.col("m_allow") * spread("block") + F.col("m_block") * spread("allow"))
                                        / (spread("allow") + spread("block")), F.lit(0.0)).alias("threshold"))
    judged = ruled.join(scored.select("url", "score"), ruled["url"].eqNullSafe(scored["url"]), "left").drop(scored["url"])
    score = F.coalesce("score", F.lit(0.0))
    return judged.select("page_id", "host", "path", "rule",
                         F.coalesce("ruled", F.when(score >= threshold.scalar(), "allow").otherwise("block")).alias("verdict"),
                         score.alias("score"))
