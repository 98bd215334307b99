"""MinHash near-duplicate groups with sequential Bayesian verification (operator 4).

1. Every document's set of 5-word shingles (hashed) gives a size, a digest of the whole set,
   BANDS x ROWS minima, the band keys, and one byte of each minimum as its signature.
2. Equal sets are one node with a number of its own; only the member with the smallest id and
   text hashes goes on.  Up to step 5 a "doc_id" below is such a number, so rows that share an id
   but not a set are different nodes with their own texts.
3. Documents that share a band key are candidates.  In a leader round the members of a bucket are
   compared with one leader of the bucket, not with each other, and after it linked documents are
   contracted to one label.  A round passes over the members that already have the leader's label and
   over buckets with one label; ROUNDS rounds have a leader each, chosen by a hash.  Then those
   pairs follow which are in one bucket, still have different labels, and whose sizes and
   signatures allow the threshold.  Pairs inside a label are never formed: a group of n near copies
   costs about n pairs a round, and what stays open is compared because nothing links it so far.
4. Each pair's signatures are compared in batches.  After a batch the posterior of the
   similarity, given the matches so far and a uniform prior, bounds it: when
   P(similarity >= threshold) falls below MISS the pair is dropped.  Survivors are decided on
   the two full shingle sets, computed from the two whole texts.
5. Confirmed links, and links between the nodes of a repeated id, are joined to components named
   by their smallest id; a document is kept if its id is its component's.

Miss probabilities: a pair of similarity 0.75 shares no band with probability
(1 - 0.75**ROWS)**BANDS = 1.2e-6, more similar ones far less; MISS adds at most 1e-6 a look.

Cases: null texts and texts without words have empty sets and are linked with nothing, not
even with each other; fewer than 5 words are one shingle; every row is judged by its own
text, repeated rows with one id fall into one component; rows with a null id have a null component
and are kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, discard, likely, pick, staged, text_slices
from .components import components
from .textarrays import Words, mix, signed

SHINGLE = 5
THRESHOLD = (75, 100)        # intersection / union >= 75 / 100
BANDS, ROWS = 36, 4
ROUNDS = 2                   # leader rounds before the pairs of different labels
FINE = 4096                  # hashes of the last round's signature, 1 bit each
COARSE = 512                 # as many of them as are looked at first
BATCH = 16                   # signature bytes compared between two looks at the posterior
MISS = 1e-6
_U = np.uint64


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of every text of a slice."""
    w = Words(texts, lower=True)
    h = w.hashes()
    run, inside = w.runs(h, SHINGLE)
    sizes = np.diff(w.first)
    out = []
    short = {}
    for k in range(1, SHINGLE):
        if (sizes == k).any():
            short[k] = w.runs(h, k)[0]
    for i, n in enumerate(sizes):
        a = w.first[i]
        if n >= SHINGLE:
            out.append(np.unique(run[a:a + n - SHINGLE + 1]))
        elif n:
            out.append(mix(short[int(n)][a:a + 1] + _U(int(n))))
        else:
            out.append(np.zeros(0, _U))
    return out


@functools.lru_cache(maxsize=2)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return (rng.integers(1, 1 << 63, n, dtype=np.int64).astype(_U) * _U(2) + _U(1),
            rng.integers(0, 1 << 63, n, dtype=np.int64).astype(_U))


def minima(sets: list[np.ndarray], n: int = BANDS * ROWS, seed: int = 4) -> np.ndarray:
    """n 32-bit minima of every non-empty set; zeros for empty ones."""
    out = np.zeros((len(sets), n), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[i] for i in full])
        first = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        for j, (a, b) in enumerate(zip(*_permutations(n, seed), strict=True)):
            out[full, j] = np.minimum.reduceat(((flat * a + b) >> _U(32)).astype(np.uint32), first)
    return out


_AFTER_ALL = (1 << 63) - 1   # stands for a null id
ROW = ["key", "t1", "t2"]   # names a row up to rows equal in id and text
_SAME = ["n_shingles", "d1", "d2"]
_SKETCH = "doc_id long, key long, t1 long, t2 long, n_shingles long, d1 long, d2 long, signature binary, bands array<long>"


def _sketch(batches):
    for batch in batches:
        for a, b in text_slices(batch["text"]):
            part = batch.slice(a, b - a)
            sets = shingle_sets(part["text"])
            low = minima(sets)
            keys = np.zeros((len(sets), BANDS), dtype=_U)
            for r in range(ROWS):
                keys = keys * _U(0x9E3779B97F4A7C15) + low[:, r::ROWS].astype(_U)
            keys = mix(keys + (np.arange(BANDS, dtype=_U) << _U(56)))
            digest = [(int(mix(s).sum(dtype=_U)), int(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))) for s in sets]
            digest = np.array(digest, dtype=_U).reshape(-1, 2)
            signature = low.astype(np.uint8)
            yield pa.record_batch({c: part[c] for c in ("doc_id", *ROW)} | {
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "d1": pa.array(signed(digest[:, 0].copy())), "d2": pa.array(signed(digest[:, 1].copy())),
                "signature": pa.array([x.tobytes() for x in signature], pa.binary()),
                "bands": pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), signed(keys.ravel()))})


def _fine(batches):
    """(doc_id, signs): the lowest bit of FINE minima, 64 to a word."""
    words = FINE // 64
    for batch in batches:
        for a, b in text_slices(batch["text"], 1 << 19):
            part = batch.slice(a, b - a)
            bits = np.packbits((minima(shingle_sets(part["text"]), FINE, 5) & 1).astype(np.uint8), axis=1)
            packed = np.ascontiguousarray(bits).view(_U)
            yield pa.record_batch({"doc_id": part["doc_id"],
                                   "signs": pa.ListArray.from_arrays(np.arange(0, packed.size + 1, words, dtype=np.int32), signed(packed.ravel()))})


def _able(a: str, b: str) -> Column:
    """Whether the posterior leaves the threshold possible after COARSE, then after FINE values."""
    t = THRESHOLD[0] / THRESHOLD[1]

    def differ(x: Column, y: Column) -> Column:
        return F.bit_count(x.bitwiseXOR(y))

    coarse = functools.reduce(lambda x, y: x + y, [differ(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(COARSE // 64)])
    fine = F.aggregate(F.zip_with(a, b, differ), F.lit(0), lambda x, y: x + y)
    return ((coarse <= COARSE - least_matches(COARSE, t, values=2)) & (fine <= FINE - least_matches(FINE, t, values=2)))


@functools.lru_cache(maxsize=16)
def least_matches(n: int, threshold: float, miss: float = MISS, values: int = 256) -> int:
    """The fewest of n compared signature values that must match for P(similarity >= threshold) to reach ``miss``.

    A value matches with probability s + (1 - s) / values; the prior of s is uniform.
    """
    s = (np.arange(4000) + 0.5) / 4000
    c = s + (1 - s) / values
    for m in range(n + 1):
        logl = m * np.log(c) + (n - m) * np.log(1 - c)
        like = np.exp(logl - logl.max())
        if like[s >= threshold].sum() >= miss * like.sum():
            return m
    return n + 1


def _prune(threshold: float):
    looks = [(n, least_matches(n, threshold)) for n in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches):
        width = BANDS * ROWS
        for batch in batches:
            left = np.frombuffer(b"".join(batch["sa"].to_pylist()), np.uint8).reshape(-1, width)
            right = np.frombuffer(b"".join(batch["sb"].to_pylist()), np.uint8).reshape(-1, width)
            alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int64)
            for n, least in looks:
                matches[alive] += (left[alive, n - BATCH:n] == right[alive, n - BATCH:n]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            yield pa.record_batch({"a": batch["a"].take(pa.array(alive)), "b": batch["b"].take(pa.array(alive))})
    return run


def _confirm(batches):
    p, q = THRESHOLD
    for batch in batches:
        for lo, hi in text_slices(batch["tb"]):
            part = batch.slice(lo, hi - lo)
            # A leader's text is repeated for each of its pairs: one set a distinct leader.
            leaders = part["a"].dictionary_encode()
            first = np.unique(leaders.indices.to_numpy(), return_index=True)[1]
            left = shingle_sets(part["ta"].take(pa.array(first)))
            right = shingle_sets(part["tb"])
            ok = []
            for i, j in enumerate(leaders.indices.to_numpy()):
                common = len(np.intersect1d(left[j], right[i], assume_unique=True))
                ok.append(common > 0 and q * common >= p * (len(left[j]) + len(right[i]) - common))
            mask = pa.array(ok, pa.bool_())
            yield pa.record_batch({"a": part["a"].filter(mask), "b": part["b"].filter(mask)})


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) pairs whose full sets reach the threshold; staged."""
    small = nodes.select("doc_id", "n_shingles", "signature")
    near = THRESHOLD[1] * F.least("na", "nb") >= THRESHOLD[0] * F.greatest("na", "nb")
    sized = pairs.join(small.toDF("a", "na", "sa"), "a").join(small.toDF("b", "nb", "sb"), "b").where(near)
    alive = sized.select("a", "sa", "b", "sb").mapInArrow(_prune(THRESHOLD[0] / THRESHOLD[1]), "a long, b long")
    # A member's text joins before its leader's, which many pairs share.
    both = alive.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "ta", "b", "tb")
    return staged(both.mapInArrow(_confirm, "a long, b long"), "links")


def _leader_pairs(labelled: DataFrame, turn: int) -> DataFrame:
    """(a, b): each bucket's leader of this turn with the bucket's members of other labels."""
    leaders = labelled.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "label")).alias("r"))
    return (labelled.join(leaders.select("key", F.col("r.doc_id").alias("a"), F.col("r.label").alias("of")), "key").where(F.col("label") != F.col("of"))
            .select("a", F.col("doc_id").alias("b")).distinct())


def _open(labelled: DataFrame) -> DataFrame:
    """The rows of buckets that hold several labels; staged."""
    keys = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return staged(labelled.join(keys, "key"), "open")


def _rest_pairs(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs of different labels that share a bucket and may reach the threshold; staged.

    ``members`` has key, doc_id, n_shingles and label.  The most frequent label of a bucket is only compared with the bucket's other members,
    never with itself.  Size classes are powers of the squared ratio of the threshold, so the sizes within the ratio of one
    lie in at most two, and the class is part of the join key.  These documents get a longer signature, and the posterior given it
    is part of the join's condition, so pairs that cannot reach the threshold never become rows; a pair
    becomes a row in the first of its shared buckets only.
    """
    step = math.log(THRESHOLD[1] / THRESHOLD[0])
    signed_ = texts.join(members.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_fine, "doc_id long, signs array<long>")
    shared = members.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))      # BANDS keys at most
    largest = (members.groupBy("key", "label").count().groupBy("key")
               .agg(F.max_by("label", F.struct("count", "label")).alias("largest")))
    # Signatures come last, so only these rows and what they join to are exchanged with them.
    m = staged(members.join(largest, "key").join(shared, "doc_id").join(signed_, "doc_id"), "classes")
    power = F.log(F.col("n_shingles").cast("double")) / step
    lo, hi = (F.floor((power + reach) / 2) for reach in (-1 - 1e-9, 1 + 1e-9))      # rounding of the logarithm included
    left = m.where(F.col("label") != F.col("largest")).select(
        "key", F.floor(power / 2).alias("c"), F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("n_shingles").alias("na"), F.col("signs").alias("qa"), F.col("keys").alias("ka"))
    right = m.select(F.col("key").alias("key_b"), F.explode(F.sequence(lo, hi)).alias("cb"), "largest",
                     F.col("doc_id").alias("b"), F.col("label").alias("lb"), F.col("n_shingles").alias("nb"), F.col("signs").alias("qb"), F.col("keys").alias("kb"))
    near = THRESHOLD[1] * F.least("na", "nb") >= THRESHOLD[0] * F.greatest("na", "nb")
    once = (F.col("lb") == F.col("largest")) | (F.col("a") < F.col("b"))
    here = F.array_min(F.array_intersect("ka", "kb")) == F.col("key")      # of all buckets a pair shares, the first
    on = (F.col("key") == F.col("key_b")) & (F.col("c") == F.col("cb")) & (F.col("la") != F.col("lb")) & once & near & _able("qa", "qb") & here
    pairs = staged(left.join(right, on).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "rest")
    discard(m)
    return pairs


def addressed(d: DataFrame) -> DataFrame:
    """``d`` (doc_id, text, ...) with the columns that name a row."""
    return d.withColumns({"key": F.coalesce("doc_id", F.lit(_AFTER_ALL)), "t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})


def _linked(docs: DataFrame, null_ids: bool) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The rows' sketches, the nodes, and the links of all rounds; staged.  Rows without an id are no nodes unless ``null_ids``."""
    d = addressed(pick(docs, doc_id="long", text="string"))
    sketches = staged(d.mapInArrow(_sketch, _SKETCH), "sketches")
    usable = sketches.where("n_shingles > 0" if null_ids else "n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = staged(usable.groupBy(*_SAME).agg(F.min(F.struct(*ROW)).alias("r"), F.min_by(F.struct("signature", "bands"), F.struct(*ROW)).alias("s"))
                   .select(*_SAME, F.monotonically_increasing_id().alias("doc_id"), "r.*", "s.signature", "s.bands"), "nodes")
    rows = nodes.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = staged(rows.join(shared, "key"), "buckets")
    # The texts of all candidates, fetched once for both rounds.
    wanted = staged(nodes.select("doc_id", *ROW).join(buckets.select("doc_id").distinct(), "doc_id"), "wanted")
    named = likely(d.where(F.col("text").isNotNull()).drop("doc_id"), wanted, ROW).join(wanted, ROW).select("doc_id", "text")
    # Rows equal in id and text are one; the table lies by node, so the rounds below move pairs to it.
    texts = bucketed(named, "doc_id", "texts")
    members, links = buckets.withColumn("label", F.col("doc_id")), None
    for turn in range(ROUNDS):
        new = _verified(_leader_pairs(members, turn), nodes, texts)
        links = [*(links or []), new]
        labels = components(functools.reduce(DataFrame.union, links))
        old, known = members, labels.select(F.col("node").alias("doc_id"), F.col("label").alias("known"))
        members = _open(old.join(known, "doc_id", "left").withColumn("label", F.coalesce("known", "label")).drop("known"))
        discard(labels)
        if turn:
            discard(old)
    rest = _rest_pairs(members, texts)
    links.append(_verified(rest, nodes, texts))
    discard(buckets, wanted, texts, members, rest)
    return sketches, nodes, links


def _grouped(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes with ``group``, their component."""
    return (nodes.drop("signature", "bands").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .withColumn("group", F.coalesce("label", "doc_id")))


def _of_one_id(sketches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): the first and every other node of an id whose rows have different sets."""
    usable = sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), *_SAME)
    several = (usable.groupBy("id").agg(*[f(c).alias(f"{n}_{c}") for c in ("d1", "d2") for n, f in (("lo", F.min), ("hi", F.max))])
               .where("lo_d1 < hi_d1 OR lo_d2 < hi_d2").select("id"))
    named = usable.join(several, "id").join(nodes.select(*_SAME, "doc_id"), _SAME).select("id", "doc_id").distinct()
    return named.join(named.groupBy("id").agg(F.min("doc_id").alias("a")), "id").where("a < doc_id").select("a", F.col("doc_id").alias("b"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """key, t1, t2 of the one row that every group of near-duplicate rows keeps: the smallest id, null last; staged.

    Rows are linked by their texts alone, those under null or repeated ids too; rows without words are in no group.
    """
    sketches, nodes, links = _linked(docs, null_ids=True)
    labels = components(functools.reduce(DataFrame.union, links))
    out = staged(_grouped(nodes, labels).groupBy("group").agg(F.min(F.struct(*ROW)).alias("r")).select("r.*"), "kept")
    discard(sketches, nodes, labels, *links)
    return out


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``; see the module's notes."""
    sketches, nodes, links = _linked(docs, null_ids=False)
    labels = components(functools.reduce(DataFrame.union, [*links, _of_one_id(sketches, nodes)]))
    grouped = _grouped(nodes, labels)
    lowest = grouped.groupBy("group").agg(F.min("key").alias("lowest"))
    member = (sketches.join(grouped.join(lowest, "group").select(*_SAME, "lowest"), _SAME, "left")
              .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id"))))
    out = staged(member.select("doc_id", "n_shingles", "component_id",
                               F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), "near-dedup")
    discard(sketches, nodes, labels, *links)
    return out
