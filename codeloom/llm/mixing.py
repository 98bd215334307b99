"""Mixing sources to target weights on a low-discrepancy schedule (operator 5).

* Sizes are words.  Sources, in code-point order with null last, weigh 5, 2, 1, repeating;
  their shares of all words are the targets, stopped at MOST_REPEATS times the source's size,
  with the excess reshared by weight until no source is above.
* The documents of a source stand in a line in a hash order; the line repeats as often as
  needed and is cut into blocks of BLOCK words.  A source's quota is its rounded target, so a
  document is taken once a full repeat plus what the quota reaches of it in the last one.
* The n blocks of all quotas are the cells of a line cut by the cumulative weights.  Slot i of
  the schedule points to cell (i * g) mod n, g the integer coprime to n nearest to n divided by
  the golden ratio: a golden-ratio point sequence in which every cell comes exactly once, so in
  any stretch of the schedule each source has its share to within a few blocks.
* Slots are ranked within their source, rank r takes the source's block r, and blocks take the
  pieces of documents they cut.  ``mixture`` is that table, the interleaved mixture in slot order;
  ``mix`` and ``mixed_documents`` sum up its rows.

Ranks and positions in a line are prefix sums in two levels (per chunk, then inside the chunk),
so no window holds a whole source.  The table of sources has a row a source; ranking and capping
sources by weight are windows over that table.

Cases: null and empty texts have size 0 and are not taken; a null source is a source; repeated
rows are documents of their own (rows equal in id, source and text are interchangeable); sources
of size 0 have target 0; other columns are ignored; an empty table gives no rows.  Order, and so
every result, depends on ids and texts only, not on partitions or runs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, pick, staged

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK = 1_024          # words a block
CHUNK = 1 << 16        # slots a chunk of the rank's prefix sums
ORDER_DIGITS = 4       # hex digits of the order hash that make a chunk of a source's line
_BINS = 4_096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, position (from 1), weight, target, quota: a row a source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    s = s.withColumn("position", F.row_number().over(by_name)).withColumn(
        "weight", F.get(weights, (F.col("position") - 1) % len(WEIGHTS)))
    # Sources by the level at which they reach their cap; at the first one whose level the common
    # level does not pass, all before it are capped and the rest share what is left.
    cap = MOST_REPEATS * F.col("source_size")
    by_level = Window.orderBy(cap / F.col("weight"), "position")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_capped", F.coalesce(F.sum(cap).over(before), F.lit(0))).withColumn(
        "_weighed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    whole = Window.partitionBy()
    left = (F.sum("source_size").over(whole) - F.col("_capped")) / (F.sum("weight").over(whole) - F.col("_weighed"))
    s = s.withColumn("_level", left)
    level = F.min(F.when(F.col("_level") * F.col("weight") <= cap, F.struct("_capped", "position", "_level"))).over(whole)["_level"]
    s = s.withColumn("target", F.least(cap.cast("double"), level * F.col("weight")))
    return s.select("source", "source_size", "position", "weight", "target", F.floor(F.col("target") + 0.5).alias("quota"))


def _row_key() -> list[Column]:
    """128 bits that name a row by id, source and text; equal rows share them."""
    return [F.xxhash64("doc_id", "source", "text").alias("k1"), F.xxhash64("text", F.lit(1), "source", F.lit(2), "doc_id").alias("k2")]


def positions(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every row with ``start``, its first word's place in its source's line, and its source's target; and the sources.

    doc_id, k1, k2 (see _row_key), size, source_size, target, position (of the source), quota, start; no texts.
    """
    d = pick(docs, doc_id="long", text="string", source="string")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":mix")))
    d = d.select("doc_id", "source", n_words(F.col("text")).alias("size"), order.alias("hash"), *_row_key())
    d = staged(d.withColumn("chunk", F.left("hash", F.lit(ORDER_DIGITS))), "mix-sizes")
    sources = staged(targets(d.select("source", "size")), "mix-sources")
    chunks = d.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(F.col("source").alias("_s"), F.col("chunk").alias("_c"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "chunk").orderBy("hash", "doc_id", "size", "k1", "k2").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(offsets, d["source"].eqNullSafe(offsets["_s"]) & (d["chunk"] == offsets["_c"]))
    s = sources.withColumnRenamed("source", "_name").drop("weight")
    d = d.join(s, d["source"].eqNullSafe(s["_name"]))
    return d.select("doc_id", "k1", "k2", "size", "source_size", "target", "position", "quota",
                    (F.col("offset") + F.col("_before")).alias("start")), sources


def _step(n: int) -> int:
    """The integer coprime to n nearest to n divided by the golden ratio."""
    g = max(1, round(n * (math.sqrt(5) - 1) / 2))
    for d in range(n + 1):
        for x in (g - d, g + d):
            if 0 < x <= max(1, n - 1) and math.gcd(x, n) == 1:
                return x
    return 1


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot (from 0), position (of the source), block: every block of every quota exactly once."""
    spark = sources.sparkSession
    upto = Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    cells = (sources.select("position", F.ceil(F.col("quota") / F.lit(block)).alias("blocks"))
             .withColumn("hi", F.sum("blocks").over(upto)).withColumn("lo", F.col("hi") - F.col("blocks")).where("blocks > 0"))
    n = cells.agg(F.max("hi")).first()[0] or 0
    if not n:
        return spark.range(0).select(F.col("id").alias("slot"), F.col("id").cast("int").alias("position"), F.col("id").alias("block"))
    width = -(-n // _BINS)
    binned = cells.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)))).drop("blocks")
    big = "decimal(19,0)"
    slots = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.col("id").cast(big) * F.lit(_step(n)).cast(big), F.lit(n).cast(big)).cast("long").alias("cell"))
    slots = slots.withColumn("bin", F.floor(F.col("cell") / width)).join(binned, "bin").where("cell >= lo AND cell < hi").select("slot", "position")
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    counts = slots.groupBy("position", "chunk").count()
    before = Window.partitionBy("position").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("position", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("position", "chunk").orderBy("slot")
    return (slots.withColumn("_r", F.row_number().over(inside) - 1).join(offsets, ["position", "chunk"])
            .select("slot", "position", (F.col("offset") + F.col("_r")).alias("block")))


def pieces(placed: DataFrame, block: int = BLOCK) -> DataFrame:
    """The parts of documents that blocks cut: position, block, start (of the document), repeat, first and last (word of the document, from 0)."""
    repeats = F.when((F.col("size") > 0) & (F.col("quota") > F.col("start")),
                     F.sequence(F.lit(0), F.floor((F.col("quota") - 1 - F.col("start")) / F.col("source_size")).cast("int")))
    p = placed.select("position", "start", "size", "quota", "source_size", F.explode(repeats).alias("repeat"))
    lo = F.col("start") + F.col("repeat") * F.col("source_size")
    p = p.select("position", "start", "repeat", lo.alias("lo"), F.least(lo + F.col("size"), F.col("quota")).alias("hi"))
    p = p.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor((F.col("hi") - 1) / block))))
    first, end = F.greatest("lo", F.col("block") * block), F.least("hi", (F.col("block") + 1) * block)
    return p.select("position", "block", "start", "repeat", (first - F.col("lo")).alias("first"), (end - 1 - F.col("lo")).alias("last"))


def _scheduled(placed: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """The pieces with the slot of their block, and their words."""
    return (pieces(placed, block).join(schedule(sources, block), ["position", "block"])
            .withColumn("words", F.col("last") - F.col("first") + 1))


def mixture(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, block, doc_id, repeat, start, first, last: the mixture; ordered by slot, repeat, start it can be read off.

    first and last are words of the document, from 0; ``start`` is the document's place in its source's line.
    """
    placed, sources = positions(docs)
    placed = staged(placed, "mix-placed")
    rows = _scheduled(placed, sources, block).join(placed.where("size > 0").select("position", "start", "doc_id"), ["position", "start"])
    return rows.join(sources.select("position", "source"), "position").select("slot", "source", "block", "doc_id", "repeat", "start", "first", "last")


def mix(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    placed, sources = positions(docs)
    placed = staged(placed, "mix-placed")
    taken = _scheduled(placed, sources, block).groupBy("position", "start").agg(F.sum("words").alias("taken"))
    out = placed.join(taken, ["position", "start"], "left")
    got = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select("doc_id", "size", "source_size", "target", got.alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, source, repeat, n_taken, slot (and the string columns named in ``carry``): a row a document and repeat that the schedule takes.

    ``slot`` is the first slot that has words of the row; ``mixture`` has all of them.
    The text is the document's own; only the document at which a quota ends inside a repeat is
    cut, to its first ``n_taken`` words joined by a blank.
    """
    placed, sources = positions(docs)
    placed = staged(placed, "mix-placed")
    taken = _scheduled(placed, sources, block).groupBy("position", "start", "repeat").agg(F.sum("words").alias("n_taken"), F.min("slot").alias("slot"))
    chosen = placed.where("size > 0").join(taken, ["position", "start"]).select("k1", "k2", "size", "repeat", "n_taken", "slot")
    # The texts move once, to the rows that name them; equal rows are one text under several places.
    d = pick(docs, doc_id="long", **{c: "string" for c in dict.fromkeys(("text", "source", *carry))})
    texts = d.select(*d.columns, *_row_key()).dropDuplicates(["k1", "k2"])
    out = texts.join(chosen, ["k1", "k2"])
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.col("n_taken").cast("int")), " ")
    return out.select("doc_id", F.when(F.col("n_taken") < F.col("size"), cut).otherwise(F.col("text")).alias("text"), "source", "repeat", "n_taken", "slot", *carry)
