"""Quality classifier by compression (operator 9).

One zstandard dictionary is built from good and one from bad labelled text.  A text is
compressed with either; the difference of the two sizes over their sum says which kind it
resembles, and a logistic fit on labelled texts kept out of the dictionaries turns the
difference into a calibrated score (weighted by the true class sizes).

Both steps take a bounded sample: about SAMPLE_PER_CLASS labelled texts a class, chosen by a
hash of the id against the class's count in the labels table; half builds the dictionaries, half calibrates.  A
dictionary holds DICT_BYTES of content and is made from about MOST_BYTES of a class, all of its texts' pieces of PIECE
bytes or as large a share of them, chosen by a hash of id and place over the whole texts; that and no more
is sent to the driver.  Every text is then compressed whole, twice, where it lies; nothing is shuffled.

Cases: a null or empty text has difference 0; without both classes among the training rows
the score is 1.0 if only good ones were seen, else 0.0; null or other labels are not learned
from; repeated rows are scored each by itself; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, held_out, labelled_sample, pick, staged
from .toxicity import platt

SAMPLE_PER_CLASS = 2_000
DICT_BYTES = 112_640
PIECE = 512              # bytes of one training piece
LEVEL = 3
MOST_BYTES = 100 * DICT_BYTES    # of a class, for one dictionary


def _cut(shares: dict[int, float]):
    """mapInArrow: (label, piece) of the pieces whose hash of id and place lies within the label's share."""
    def run(batches):
        for batch in batches:
            for doc_id, label, text in zip(batch["doc_id"].to_pylist(), batch["label"].to_pylist(), batch["text"], strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                limit = shares.get(label, 0.0) * (1 << 32)
                kept = [raw[at:at + PIECE] for at in range(0, len(raw), PIECE) if zlib.crc32(b"%d:%d" % (doc_id, at)) < limit]
                if kept:
                    yield pa.record_batch({"label": pa.array([label] * len(kept), pa.int32()), "piece": pa.array(kept, pa.binary())})
    return run


def pieces(sample: DataFrame, most_bytes: int = MOST_BYTES) -> dict[int, list[bytes]]:
    """label -> pieces of its texts (doc_id, text, label), about ``most_bytes`` of them, in an order of their own."""
    sizes = sample.groupBy("label").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).collect()
    shares = {r["label"]: min(1.0, most_bytes / max(r["n"], 1)) for r in sizes}
    rows = sample.select("doc_id", "label", "text").mapInArrow(_cut(shares), "label int, piece binary").toArrow()
    out: dict[int, list[bytes]] = {0: [], 1: []}
    for label, piece in zip(rows["label"].to_pylist(), rows["piece"].to_pylist(), strict=True):
        out[label].append(piece)
    # By a hash: neither the partitioning nor the texts' beginnings decide what the trainer sees first.
    return {label: sorted(p, key=lambda x: (zlib.crc32(x), x)) for label, p in out.items()}


def build_dictionary(of: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary trained on pieces; the pieces themselves where there is too little to train on."""
    try:
        return zstandard.train_dictionary(size, of, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(of)[:size]


class Sizer:
    """Normalised difference of the compressed sizes: above 0 where the good dictionary fits better."""

    def __init__(self, good: bytes, bad: bytes):
        self.pair = []
        for d in (good, bad):
            made = zstandard.ZstdCompressionDict(d)
            made.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: str | None) -> float:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        good, bad = (len(c.compress(raw)) for c in self.pair)
        return (bad - good) / (bad + good)


def train(docs: DataFrame, marks: DataFrame, most: int = SAMPLE_PER_CLASS) -> tuple[bytes, bytes, float, float]:
    """(good dictionary, bad dictionary, scale, offset) from docs (doc_id, text) and marks (doc_id, label 0/1)."""
    sample, sizes = labelled_sample(docs, marks, most, seed=9)
    if len(sizes) < 2:
        return b"", b"", 0.0, 40.0 if 1 in sizes else -40.0
    sample = staged(sample, "sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit(91)), F.lit(2))
    of = pieces(sample.where(half == 0))
    good, bad = build_dictionary(of[1]), build_dictionary(of[0])
    if not good or not bad:
        discard(sample)
        return good, bad, 0.0, 0.0
    cast = docs.sparkSession.sparkContext.broadcast((good, bad))

    def measure(batches):
        sizer = Sizer(*cast.value)
        for batch in batches:
            yield pa.record_batch({"label": batch["label"], "x": pa.array([sizer(t.as_py()) for t in batch["text"]], pa.float64())})

    seen = sample.where(half == 1).select("label", "text").mapInArrow(measure, "label int, x double").toArrow()
    discard(sample)
    order = np.lexsort((seen["x"].to_numpy(), seen["label"].to_numpy()))
    x, y = seen["x"].to_numpy()[order], seen["label"].to_numpy()[order]
    if len(set(y)) < 2:
        return good, bad, 20.0, 0.0
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum()) * len(y) / sum(sizes.values())
    return good, bad, *platt(x, y, weight)


def quality(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, size_difference for every row of ``docs``."""
    d = pick(docs, doc_id="long", text="string").withColumn("held_out", held_out(F.col("doc_id"), 3, 1))
    marks = pick(labels, doc_id="long", quality="int").select("doc_id", F.col("quality").alias("label")).where("label IN (0, 1)")
    marks = marks.where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    cast = docs.sparkSession.sparkContext.broadcast(train(d.select("doc_id", "text"), marks, most))

    def run(batches):
        good, bad, scale, offset = cast.value
        sizer = Sizer(good, bad) if good and bad else lambda t: 0.0
        for batch in batches:
            x = np.array([sizer(t.as_py()) for t in batch["text"]], dtype=np.float64)
            score = 1 / (1 + np.exp(-np.clip(scale * x + offset, -40, 40)))
            yield pa.record_batch({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(score),
                                   "predicted": pa.array((score >= 0.5).astype(np.int32)), "size_difference": pa.array(x)})

    return d.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int, size_difference double")
