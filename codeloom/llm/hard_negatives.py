"""Hard-negative mining by angular triangle filtering (operator 13).

1. *Stored angles.*  Reference directions are the centres of a spherical k-means over a bounded,
   hash-chosen sample.  Every vector is stored with its norm and its angles to all of them, dealt and
   sorted by nearest direction and the angle to it.
2. *Bounds.*  For an anchor a, a vector x and a direction r the angle between a and x lies in
   [|angle(a, r) - angle(x, r)|, angle(a, r) + angle(x, r)].  Its cosine at both ends, times the norms,
   bounds the score; angles are widened by SLACK and scores by a relative margin, so no rounding
   can exclude a vector that qualifies.
3. *Windows.*  What is wanted of an anchor is a set of score windows: for positives everything from its
   5th best score known so far, for negatives the stretch from 80% of a positive's score to that
   score, and there too only from the 5th best known so far.  A block of stored vectors is a stretch
   of angles to one direction: a block whose bounds miss all windows of an anchor is skipped, and in
   the others only the rows whose angle allows a window get their integer score.  The first known scores
   come from the sample.

Anchors are taken in chunks of bounded bytes, one after another: a chunk and its windows are sent to
the tasks, which read the stored vectors where they lie and keep k rows a window, so nothing but
winners is shuffled.  Scores are integers, computed exactly.

Cases: rows with a null id, a null label, a null vector, or a null or non-finite component take no
part; shorter vectors count as padded with zeros; a zero vector scores 0; identical repeated rows
count once; rows that repeat an id with another vector or label are rows of their own, but no positives
of an anchor of that id; ties go to the smaller id; an anchor without positives, or a positive without
negatives, gives no row; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir
from .common import bounded_sample, discard, pick, release, staged
from .exact_topk import _exact_type, _matrix

SCALE = 256
BEST = 5                    # positives of an anchor, negatives of a positive
LOWEST = (80, 100)          # negative score / positive score, least
REFERENCES = 24             # directions whose angles are stored
SAMPLE = 4_096              # vectors that fit the directions and give first scores, in expectation
CHUNK_BYTES = 8 << 20       # of anchors sent to the tasks at once
PARTITION_BYTES = 256 << 20  # of stored vectors
BLOCK = 512                 # stored vectors a block, at most
SLACK = 1e-5                # radians; stored angles are 32-bit
_MARGIN = 1e-9              # of a bound's size, besides one unit
_NONE = -(1 << 62)
_FOUND = "slot int, anchor_id long, other_id long, vec_id long, other_score long, score long"
_STORED = "vec_id long, label int, v array<long>, norm double, cell int, angle float, angles array<float>"


def prepared(vectors: DataFrame, scale: int = SCALE, changed: Column | None = None) -> DataFrame:
    """vec_id, label, v of the usable rows: components as floor(scale * x); ``changed`` marks labels that become (label + 1) % 10."""
    v = pick(vectors, vec_id="long", label="int", embedding="array<double>")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    label = F.col("label") if changed is None else F.when(changed, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return usable.select("vec_id", label.cast("int").alias("label"), F.transform("embedding", lambda x: F.floor(x * scale)).alias("v")).distinct()


def directions(sample: np.ndarray, n: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """At most n unit vectors: centres of the sample's directions (spherical k-means, from spread starts)."""
    x = sample.astype(np.float64)
    size = np.linalg.norm(x, axis=1)
    x = np.unique(x[size > 0] / size[size > 0][:, None], axis=0)
    if not len(x):
        return np.eye(1, sample.shape[1])
    centres, near = x[:1], x @ x[0]
    while len(centres) < min(n, len(x)):                        # the farthest from all so far
        centres = np.vstack([centres, x[near.argmin()]])
        near = np.maximum(near, x @ centres[-1])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1)
        centres = np.where((size > 1e-9)[:, None], total / np.maximum(size, 1e-9)[:, None], centres)
    return centres


def angles_to(refs: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to every direction (0 for zero vectors, whose scores are 0 at any angle)."""
    x = v.astype(np.float64)
    norm = np.linalg.norm(x, axis=1)
    cosine = (x @ refs.T) / np.where(norm > 0, norm, 1)[:, None]
    return norm, np.arccos(np.clip(np.where((norm > 0)[:, None], cosine, 1), -1, 1))


def _store(refs: np.ndarray, width: int):
    def run(batches):
        for batch in batches:
            v = _matrix(batch["v"], width)
            norm, angles = angles_to(refs, v)
            cell = angles.argmin(axis=1).astype(np.int32)
            yield pa.record_batch({
                **{c: batch[c] for c in ("vec_id", "label", "v")}, "norm": pa.array(norm), "cell": pa.array(cell),
                "angle": pa.array(angles[np.arange(len(v)), cell].astype(np.float32)),
                "angles": pa.ListArray.from_arrays(np.arange(0, angles.size + 1, angles.shape[1], dtype=np.int32), angles.astype(np.float32).ravel())})
    return run


class Wanted:
    """The anchors of a chunk and their windows.

    A slot is one window of one anchor: scores from ``low`` to ``high`` (both included) of rows with the anchor's
    label (``same``) or another; ``kept`` of a slot are its k best, and ``low`` rises to the k-th.
    """

    def __init__(self, ids, labels, v, norm, angles, same: bool, slot_anchor, low, high, k: int = BEST):
        self.ids, self.labels, self.v, self.norm, self.angles, self.same, self.k = ids, labels, v, norm, angles, same, k
        self.slot_anchor, self.low, self.high = slot_anchor, low.copy(), high
        none = np.zeros(0, np.int64)
        self.kept = (none, none, none)                          # slot, vec_id, score
        self._pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scored = self.seen = 0                             # pairs that got a score, pairs in all
        self._slots = np.argsort(slot_anchor, kind="stable")
        self._first = np.searchsorted(slot_anchor[self._slots], np.arange(len(ids) + 1))
        self._ranges()

    def _ranges(self) -> None:
        """Each anchor's lowest and highest wanted score; nothing for anchors without slots."""
        self.least = np.full(len(self.ids), float("inf"))
        self.most = np.full(len(self.ids), float("-inf"))
        np.minimum.at(self.least, self.slot_anchor, self.low.astype(np.float64))
        np.maximum.at(self.most, self.slot_anchor, self.high.astype(np.float64))

    def block(self, ids, labels, v, norm, angles, cell: int) -> None:
        """One block: rows in the order of their angle to direction ``cell``."""
        self.seen += len(ids) * len(self.ids)
        lo, hi, small, large = angles.min(axis=0), angles.max(axis=0), norm.min(), norm.max()
        nearest = np.maximum(np.maximum(self.angles - hi, lo - self.angles), 0).max(axis=1) - SLACK
        most, least = self.angles + hi, self.angles + lo        # two angles that add to more than half a turn leave the rest of the turn
        farthest = np.where(most <= np.pi, most, np.where(least >= np.pi, 2 * np.pi - least, np.pi)).min(axis=1) + SLACK
        top, bottom = np.cos(np.maximum(nearest, 0)), np.cos(np.minimum(farthest, np.pi))
        wide = 1 + _MARGIN * self.norm * large
        upper = self.norm * top * np.where(top > 0, large, small) + wide
        lower = self.norm * bottom * np.where(bottom > 0, small, large) - wide
        alive = np.flatnonzero((upper >= self.least) & (lower <= self.most))
        if not len(alive):
            return
        begin, end = self._windows(alive, angles[:, cell], cell, small, large, wide[alive])
        some = begin < end
        alive, begin, end = alive[some], begin[some], end[some]
        for label in (np.unique(labels) if self.same else [None]):
            a = np.ones(len(alive), bool) if label is None else self.labels[alive] == label
            if a.any():
                rows = np.arange(begin[a].min(), end[a].max())
                if label is not None:
                    rows = rows[labels[rows] == label]
                self._score(alive[a], rows, begin[a], end[a], ids, labels, v)

    def _windows(self, a, here, cell: int, small, large, wide):
        """For each anchor the stretch of rows, sorted by angle ``here``, that its scores' range allows."""
        ratio = lambda t, n: np.divide(t, n, out=np.where(t > 0, np.inf, -np.inf), where=n > 0)
        low, high = self.least[a] - wide, self.most[a] + wide
        # The norm that allows most: the largest for scores above 0, the smallest below; the other way round from above.
        away = ratio(low, self.norm[a] * np.where(low > 0, large, small))
        near = ratio(high, self.norm[a] * np.where(high > 0, small, large))
        away = np.where(away > 1, -1.0, np.arccos(np.clip(away, -1, 1)))        # no farther than this
        near = np.arccos(np.clip(near, -1, 1))                                  # no nearer than this
        own = self.angles[a, cell]
        first = np.maximum(own - away, near - own) - SLACK
        last = np.where(away < 0, -1.0, np.minimum(own + away, 2 * np.pi - near - own) + SLACK)
        return np.searchsorted(here, first, side="left"), np.searchsorted(here, last, side="right")

    def _score(self, a, rows, begin, end, ids, labels, v) -> None:
        window = (rows[None, :] >= begin[:, None]) & (rows[None, :] < end[:, None])
        self.scored += int(window.sum())
        kind = _exact_type(self.v, v)
        score = (self.v[a].astype(kind) @ v[rows].astype(kind).T).astype(np.int64)
        fit = window & (score >= self.least[a][:, None]) & (score <= self.most[a][:, None])
        fit &= (self.ids[a][:, None] != ids[rows][None, :]) if self.same else (self.labels[a][:, None] != labels[rows][None, :])
        x, y = np.nonzero(fit)
        if len(x):
            self._offer(a[x], ids[rows[y]], score[x, y])

    def _offer(self, anchor, ids, score) -> None:
        """(anchor, id, score) entries to the anchor's slots whose window they fit."""
        order, first = self._slots, self._first
        n = (first[1:] - first[:-1])[anchor]
        at = np.repeat(np.arange(len(anchor)), n)
        slot = order[np.repeat(first[anchor], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        fit = (score[at] >= self.low[slot]) & (score[at] <= self.high[slot])
        self._pending.append((slot[fit], ids[at[fit]], score[at[fit]]))
        if sum(len(p[0]) for p in self._pending) > 500_000:
            self.settle()

    def settle(self) -> None:
        """Keep the best of each slot and raise the windows' lower ends to the k-th."""
        if not self._pending:
            return
        slot, ids, score = (np.concatenate([k, *p]) for k, p in zip(self.kept, zip(*self._pending, strict=True), strict=True))
        self._pending = []
        order = np.lexsort((ids, -score, slot))
        slot, ids, score = slot[order], ids[order], score[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        best = rank < self.k
        self.kept = (slot[best], ids[best], score[best])
        last = rank == self.k - 1
        self.low[slot[last]] = np.maximum(self.low[slot[last]], score[last])
        self._ranges()


def _search(sent, other, width: int):
    """mapInArrow over stored vectors: the best of every slot of the chunk among the task's rows."""
    def run(batches):
        wanted = Wanted(**sent.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, cell = (batch[c].to_numpy() for c in ("vec_id", "label", "cell"))
            v, norm = _matrix(batch["v"], width), batch["norm"].to_numpy()
            angles = batch["angles"].flatten().to_numpy().reshape(len(ids), -1).astype(np.float64)
            edges = np.unique(np.concatenate([np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(ids), BLOCK), [len(ids)]]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                wanted.block(ids[a:b], labels[a:b], v[a:b], norm[a:b], angles[a:b], int(cell[a]))
            wanted.settle()
        slot, ids, score = wanted.kept
        other_id, other_score = other.value
        yield pa.record_batch({"slot": pa.array(slot, pa.int32()), "anchor_id": pa.array(wanted.ids[wanted.slot_anchor[slot]], pa.int64()),
                               "other_id": pa.array(other_id[slot], pa.int64()), "vec_id": pa.array(ids, pa.int64()),
                               "other_score": pa.array(other_score[slot], pa.int64()), "score": pa.array(score, pa.int64())})
    return run


def _best(stored: DataFrame, anchors: dict, sample: tuple, same: bool, slot_anchor, low, high, other_id, other_score, width: int) -> tuple[DataFrame, list]:
    """The k best rows of every slot, ranked; and the broadcasts to drop after use."""
    first = Wanted(**anchors, same=same, slot_anchor=slot_anchor, low=low, high=high)
    by_angle = np.argsort(sample[4][:, 0])
    sample = tuple(c[by_angle] for c in sample)
    for a in range(0, len(sample[0]), BLOCK):                   # the sample's rows are rows: their scores are lower ends
        ids, labels, v, norm, angles = (c[a:a + BLOCK] for c in sample)
        first.block(ids, labels, v, norm, angles, 0)
        first.settle()
    sc = stored.sparkSession.sparkContext
    sent = sc.broadcast({**anchors, "same": same, "slot_anchor": slot_anchor, "low": first.low, "high": high})
    other = sc.broadcast((other_id, other_score))
    found = stored.mapInArrow(_search(sent, other, width), _FOUND)
    w = Window.partitionBy("slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= BEST), [sent, other]


def _columns(arrow: pa.Table, width: int) -> tuple:
    angles = arrow["angles"].combine_chunks().flatten().to_numpy().reshape(arrow.num_rows, -1 if arrow.num_rows else 1).astype(np.float64)
    return (arrow["vec_id"].to_numpy(), arrow["label"].to_numpy(), _matrix(arrow["v"], width), arrow["norm"].to_numpy(), angles)


def stored_angles(rows: DataFrame, sample_rows: int = SAMPLE, references: int = REFERENCES) -> tuple[DataFrame, int]:
    """``rows`` (vec_id, label, v) with norms and angles, staged, and the vectors' width."""
    size = rows.agg(F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    width = size["width"] or 0
    sample = bounded_sample(rows, F.struct("vec_id", "v"), sample_rows).toArrow()
    refs = directions(_matrix(sample["v"], width), references) if sample.num_rows else np.eye(1, max(width, 1))
    n = max(rows.sparkSession.sparkContext.defaultParallelism, size["n"] * 8 * (width + references) // PARTITION_BYTES)
    order = ["cell", "angle", "vec_id"]
    dealt = rows.mapInArrow(_store(refs, width), _STORED).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return staged(dealt, "angles"), width


def hard_negatives(rows: DataFrame, anchors: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows of ``anchors``; see the module's notes."""
    spark = rows.sparkSession
    rows = staged(rows, "vectors")
    stored, width = stored_angles(rows)
    sample_table = bounded_sample(stored, F.struct("vec_id", "v"), SAMPLE).toArrow()
    sample = _columns(sample_table, width)
    chosen = stored.where(anchors)
    chunks = max(1, -(-chosen.count() * 8 * (width + REFERENCES + 4) // chunk_bytes))
    path = f"{ensure_checkpoint_dir(spark)}/llm-hard-negatives-{uuid.uuid4().hex}"
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], schema).write.parquet(path)
    for c in range(chunks):
        chunk = chosen.where(F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(chunks)) == c).toArrow()
        n = chunk.num_rows
        if not n:
            continue
        sent = dict(zip(("ids", "labels", "v", "norm", "angles"), _columns(chunk, width), strict=True))
        none = np.zeros(n, np.int64)
        best, held = _best(stored, sent, sample, True, np.arange(n), np.full(n, _NONE), np.full(n, -_NONE), none, none, width)
        # At most BEST rows an anchor of the chunk.
        positives = best.select("slot", "vec_id", "score").toArrow()
        for b in held:
            b.destroy()
        slot, other, score = (positives[c].to_numpy() for c in ("slot", "vec_id", "score"))
        if not len(slot):
            continue
        least = -(-(LOWEST[0] * score) // LOWEST[1])            # the smallest integer within the ratio
        found, more = _best(stored, sent, sample, False, slot.astype(np.int64), least, score, other, score, width)
        (found.select("anchor_id", F.col("other_id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                      F.col("other_score").alias("positive_score"), F.col("score").alias("negative_score"))
         .write.mode("append").parquet(path))
        for b in more:
            b.destroy()
        release(spark)
    discard(rows, stored)
    return spark.read.schema(schema).parquet(path)
