"""Language identification with bit-sliced Bloom filters of character n-grams (operator 1).

Each slot of the filter holds a bit per language.  An n-gram sets its languages' bits in K
slots; the AND of a gram's K slots is the set of all languages that contain it, found with
K reads whatever the number of languages.  For a text, the bits are summed per language over
its n-grams (with repeats); a language whose slots are filled to share p reports a foreign
gram with probability p**K, so a count c of N grams is corrected to (c - p**K N) / (1 - p**K).
The language with the largest corrected count wins; ties go to the language with more
training texts, then to the smaller name.  The score is the corrected count over N.

The filter is fitted on a bounded sample of the training rows, about SAMPLE_PER_LANGUAGE
texts a language chosen by a hash of the id against the language's count.  A gram belongs to
a language if it makes up at least MIN_RATE of the language's grams (so a language has at
most 1 / MIN_RATE grams, whatever the sample) and its rate there is at least 1 / MAX_RATIO
of its rate in any other language, so foreign passages do not blur the filters.

Cases: null texts, and texts without a letter, get ``und`` and score 0.0, as do all texts
if no training row has a language; texts with letters always get a learned language;
repeated rows are judged each by itself; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chargrams import Letters
from .common import bounded_sample, held_out, pick, text_slices
from .textarrays import mix

GRAMS = (3, 4)
K = 3
SLOTS_PER_GRAM = 16
SAMPLE_PER_LANGUAGE = 2_000
MIN_RATE = 5e-6
MAX_RATIO = 8.0
UNKNOWN = "und"


@dataclass
class Filter:
    """slots: one row a slot, one 64-bit word per 64 languages (8- to 64-bit where one word is enough)."""
    languages: list[str]
    slots: np.ndarray
    false_positive: np.ndarray


def _grams(letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    parts = [letters.grams(n) for n in GRAMS]
    return np.concatenate([h for h, _ in parts]), np.concatenate([d for _, d in parts])


def _gram_counts(batches):
    """(lang, gram, n) per slice of texts; Spark sums them."""
    for batch in batches:
        for a, b in text_slices(batch["text"], 1 << 20):
            part = batch.slice(a, b - a)
            h, row = _grams(Letters(part["text"]))
            langs, which = np.unique(np.array(part["lang"].to_pylist(), dtype=object), return_inverse=True)
            for j, lang in enumerate(langs):
                grams, counts = np.unique(h[which[row] == j], return_counts=True)
                yield pa.record_batch({"lang": pa.array([lang] * len(grams), pa.string()),
                                       "gram": pa.array(grams.view(np.int64)), "n": pa.array(counts.astype(np.int64))})


def _positions(grams: np.ndarray, n_slots: int):
    """The K slots of every gram; n_slots is a power of two."""
    h = grams
    for _ in range(K):
        yield (h & np.uint64(n_slots - 1)).astype(np.int64)
        h = mix(h + np.uint64(0x632BE59BD9B4E019))


def build_filter(languages: list[str], grams: np.ndarray, language: np.ndarray) -> Filter:
    """From (gram, language index) pairs; the order of ``languages`` is the order that ties follow."""
    n_slots = 1 << max(10, int(np.ceil(np.log2(max(1, len(np.unique(grams))) * SLOTS_PER_GRAM))))
    words = -(-len(languages) // 64)
    kind = next((t for t, bits in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= bits), np.uint64)
    slots = np.zeros((n_slots, max(1, words)), dtype=kind)
    for at in _positions(grams, n_slots):
        np.bitwise_or.at(slots, (at, language // 64), kind(1) << (language % 64).astype(kind))
    fill = np.array([np.mean((slots[:, j // 64] >> kind(j % 64)) & kind(1)) for j in range(len(languages))])
    return Filter(languages, slots, fill ** K)


def train(labelled: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> Filter:
    """The filter from rows (doc_id, text, lang)."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}   # one row a language
    languages = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not languages:
        return Filter([], np.zeros((1, 1), np.uint8), np.zeros(0))
    sample = bounded_sample(labelled, F.col("doc_id"), most, by="lang", seed=3)
    counts = (sample.select("lang", "text").mapInArrow(_gram_counts, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    # At most 1 / MIN_RATE rows a language reach the driver.
    rates = (counts.where("n > 1").join(F.broadcast(totals), "lang")
             .select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).where(F.col("rate") >= MIN_RATE)).toArrow()
    grams, at = np.unique(rates["gram"].to_numpy(), return_inverse=True)
    index = {x: j for j, x in enumerate(languages)}
    language = np.array([index[x] for x in rates["lang"].to_pylist()], dtype=np.int64)
    rate = rates["rate"].to_numpy()
    most_rate = np.zeros(len(grams))
    np.maximum.at(most_rate, at, rate)
    own = rate * MAX_RATIO >= most_rate[at]
    return build_filter(languages, grams[at[own]].view(np.uint64), language[own])


def counts_by_language(f: Filter, h: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(corrected popcount per text and language, grams per text)."""
    total = np.bincount(row, minlength=n).astype(np.float64)
    mask = None
    for at in _positions(h, len(f.slots)):
        hit = f.slots[at]
        mask = hit if mask is None else mask & hit
    out = np.zeros((n, len(f.languages)))
    for j in range(len(f.languages)):
        bit = (mask[:, j // 64] >> f.slots.dtype.type(j % 64)) & f.slots.dtype.type(1)
        seen = np.bincount(row[bit.astype(bool)], minlength=n)
        out[:, j] = np.maximum(0.0, (seen - f.false_positive[j] * total) / (1 - f.false_positive[j]))
    return out, total


def _judge(model, carried: list[str]):
    def run(batches):
        f = model.value
        names = np.array(f.languages, dtype=object)
        for batch in batches:
            for a, b in text_slices(batch["text"], 1 << 20):
                part = batch.slice(a, b - a)
                letters = Letters(part["text"])
                h, row = _grams(letters)
                lang = np.full(letters.n, UNKNOWN, dtype=object)
                score = np.zeros(letters.n)
                if len(names):
                    count, total = counts_by_language(f, h, row, letters.n)
                    best = count.argmax(axis=1)
                    known = letters.letters > 0
                    lang[known] = names[best[known]]
                    score = np.where(known, count.max(axis=1) / np.maximum(total, 1), 0.0).clip(0.0, 1.0)
                yield pa.record_batch({"doc_id": part["doc_id"], "held_out": part["held_out"],
                                       "lang_pred": pa.array(lang.tolist(), pa.string()), "score": pa.array(score),
                                       **{c: part[c] for c in carried}})
    return run


def _with_fold(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    kinds = {"text": "string", "lang": "string", **{c: "string" for c in carry}}
    return pick(docs, doc_id="long", **kinds).withColumn("held_out", held_out(F.col("doc_id"), 4, 2))


def learn(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE) -> Filter:
    """The model of the rows that are not held out."""
    d = _with_fold(docs)
    return train(d.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"), most)


def language_id(docs: DataFrame, most: int = SAMPLE_PER_LANGUAGE, carry: tuple[str, ...] = (), model: Filter | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (and the string columns named in ``carry``) for every row of ``docs``.

    Learns from rows that are not held out, unless the ``model`` is given.
    """
    d = _with_fold(docs, carry)
    model = docs.sparkSession.sparkContext.broadcast(model or learn(docs, most))
    columns = ["doc_id", "held_out", *dict.fromkeys(["text", *carry])]
    return d.select(*columns).mapInArrow(_judge(model, list(carry)), "doc_id long, held_out boolean, lang_pred string, score double"
                                         + "".join(f", {c} string" for c in carry))
