"""Removal of repeated passages with sharded phrase automata (operator 2).

A window is WINDOW consecutive words of a text.  A word goes if a window covers it whose word
sequence also starts in a document with a smaller id; windows are judged on the input.

1. Copies.  A text with the word sequence (128-bit digest) of a document with a smaller id loses all
   its words, if it has WINDOW of them, and takes no further part.  A copy is named by its id and
   its digest: other texts under the same id, or under null ids, are judged by themselves.
2. Seeds.  Every window names the smallest hash among its ANCHOR-word runs.  Equal windows name
   the same seed, so a seed that occurs in one word sequence only rules out all its windows; a
   text has about one seed in six words.  Seeds are counted with partial aggregates.
3. Confirmation.  Documents are dealt into shards of about SHARD_ROWS by a hash of the id and the
   text, so rows of one id, or of no id, lie in many shards.  More than SHARD_ROWS rows equal in
   both are judged as one row, whose result is joined to them.  The
   windows of a shard that name a recurring seed are hashed (96 bits) once a shard, and counted
   over all shards: a phrase is confirmed if it occurs in two documents, and its first document
   is known.
4. Automata.  A shard receives the confirmed phrases whose first document comes before one of the
   shard's documents that hold them, each once, however many of its documents do.  The phrases
   are compiled into an Aho-Corasick automaton over the shard's words, and the shard's documents
   are streamed through it whole: every occurrence is located on the words themselves, and marks
   its words if the phrase's first document is smaller.

So every document meets only the phrases that can occur in it, and the work grows with the text,
not with documents times phrases.  A passage shared by a third of all documents is one row a
shard, not one a document; its seeds are pre-aggregated.  A task holds one shard at a time.

Cases: null and empty texts have no words; a null id ranks after every id (its text never counts
as first, except among null ids, which remove nothing from each other); rows that repeat an id
do not remove words from each other; texts shorter than a window lose nothing; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, release, staged, text_slices
from .textarrays import BASES, Words, signed, sliding_min

WINDOW = 13
ANCHOR = 4
SHARD_ROWS = 64
_TEXT = ("t1", "t2")               # two hashes that name a text
_AFTER_ALL = (1 << 63) - 1          # stands for a null id
_TWO = struct.Struct("<qq")         # a digest as two longs
_BYTES_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _seeds_of(w: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seed, whether the window lies in one text) for every word as a window's first."""
    grams, _ = w.runs(hashes, ANCHOR)
    seed = sliding_min(grams, WINDOW - ANCHOR + 1)
    n = len(seed)
    return seed, w.doc[:n] == w.doc[WINDOW - 1:WINDOW - 1 + n]


def _digest(text: str | None) -> bytes:
    """Names a text's word sequence."""
    return hashlib.blake2b(b" ".join((text or "").encode().split()), digest_size=16).digest()


def _seeds(batches):
    """(shard, key, words, d1, d2, seeds): a text's shard and id, its number of words, the digest of its words, its seeds."""
    for batch in batches:
        for a, b in text_slices(batch["text"]):
            part = batch.slice(a, b - a)
            w = Words(part["text"])
            seed, inside = _seeds_of(w, w.hashes())
            at = np.flatnonzero(inside)
            if len(at):
                new = np.ones(len(at), dtype=bool)
                new[1:] = (seed[at[1:]] != seed[at[:-1]]) | (w.doc[at[1:]] != w.doc[at[:-1]])
                at = at[new]
            first = np.searchsorted(w.doc[at], np.arange(part.num_rows + 1))
            digest = b"".join(map(_digest, part["text"].to_pylist()))
            two = np.frombuffer(digest, dtype="<i8").reshape(-1, 2)
            yield pa.record_batch({"shard": part["shard"], "key": part["key"], "words": pa.array(np.diff(w.first).astype(np.int64)),
                                   "d1": pa.array(two[:, 0].copy()), "d2": pa.array(two[:, 1].copy()),
                                   "seeds": pa.ListArray.from_arrays(first.astype(np.int32), signed(seed[at]))})


_SEEDS = "shard long, key long, words long, d1 long, d2 long, seeds array<long>"
_PHRASE = "shard long, h1 long, h2 int, first long, at int, last long"


def _in_order(docs: pa.Table, copies: pa.Table) -> tuple[pa.Table, list[bool]]:
    """A shard's documents by (key, text), the order in which words are numbered, and which of them are copies."""
    docs = docs.sort_by([("key", "ascending"), ("text", "ascending")]).combine_chunks()
    copies = copies.filter(pc.is_valid(copies["copy"]))
    known = set(zip(copies["copy"].to_pylist(), copies["d1"].to_pylist(), copies["d2"].to_pylist(), strict=True))
    keys = {k for k, *_ in known}
    return docs, [k in keys and (k, *_TWO.unpack(_digest(t))) in known for k, t in zip(docs["key"].to_pylist(), docs["text"].to_pylist(), strict=True)]


def _candidates(docs: pa.Table, seeds: pa.Table) -> pa.Table:
    """The distinct windows of a shard that name a recurring seed: shard, hash, first and last document (null: the first), a place.

    The place is a word of the shard, counted over its documents in order, without copies.
    """
    names = ["shard", "h1", "h2", "first", "at", "last"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()]
    none = pa.table([pa.array([], t) for t in types], names=names)
    wanted = np.unique(seeds["seed"].drop_null().to_numpy().view(np.uint64))
    if not docs.num_rows or not len(wanted):
        return none
    order, copy = _in_order(docs, seeds)
    order = order.filter(pa.array([not c for c in copy])).combine_chunks()
    if not order.num_rows:
        return none
    keys = order["key"].to_numpy()
    w = Words(order["text"].chunk(0))
    hashes = w.hashes()
    seed, inside = _seeds_of(w, hashes)
    found = np.minimum(np.searchsorted(wanted, seed), len(wanted) - 1)
    at = np.flatnonzero(inside & (wanted[found] == seed))
    if not len(at):
        return none
    h1 = signed(w.runs(hashes, WINDOW)[0][at])
    h2 = (w.runs(w.hashes(BASES[1]), WINDOW, BASES[1])[0][at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    # Windows stand in document order, so of equal ones the first has the smallest id.
    by = np.lexsort((at, h2, h1))
    h1, h2, at = h1[by], h2[by], at[by]
    start = np.ones(len(at), dtype=bool)
    start[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(at)) - 1
    lowest, highest = keys[w.doc[at[first]]], keys[w.doc[at[last]]]
    out = [np.full(len(first), docs["shard"][0].as_py()), h1[first], h2[first], lowest, at[first].astype(np.int32), highest]
    # Most windows stand in one document of the shard; a null last takes no room.
    masks = [None, None, None, None, None, highest == lowest]
    return pa.table([pa.array(x, t, mask=m) for x, t, m in zip(out, types, masks, strict=True)], names=names)


def _marked(ids: list[list[int]], keys: list[int], phrases) -> list[np.ndarray]:
    """Which words of each document go, from the shard's phrases (words of one, first document)."""
    gone = [np.zeros(len(x), dtype=bool) for x in ids]
    before: list[int] = []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for words, first in phrases:
        automaton.add_word(words, len(before))
        before.append(first)
    if not before:
        return gone
    automaton.make_automaton()
    for x, key, mark in zip(ids, keys, gone, strict=True):
        for end, phrase in automaton.iter(tuple(x)):
            if before[phrase] < key:
                mark[end - WINDOW + 1:end + 1] = True
    return gone


def _remove(carried: list[str], full: bool):
    def run(docs: pa.Table, phrases: pa.Table) -> pa.Table:
        docs, copy = _in_order(docs, phrases)
        raws = [(t or "").encode() for t in docs["text"].to_pylist()]
        keys = docs["key"].to_pylist()
        numbers: dict[bytes, int] = {}
        split = [raw.split() for raw in raws]                                    # ASCII white space: the word's own definition
        ids = [[] if c else [numbers.setdefault(x, len(numbers)) for x in words] for words, c in zip(split, copy, strict=True)]
        stream = [x for words in ids for x in words]
        places = phrases.filter(pc.is_valid(phrases["at"]))
        found = ((tuple(stream[at:at + WINDOW]), before) for at, before in zip(places["at"].to_pylist(), places["before"].to_pylist(), strict=True))
        gone = _marked(ids, keys, found)
        gone = [np.ones(len(words), dtype=bool) if c else g for words, c, g in zip(split, copy, gone, strict=True)]
        out = {"doc_id": docs["doc_id"], "n_words": pa.array([len(x) for x in split], pa.int64()),
               "n_removed": pa.array([int(g.sum()) for g in gone], pa.int64())}
        if full:
            out |= {"text": pa.array([t if t is None or not g.any() else _without(raw, g)
                                      for t, raw, g in zip(docs["text"].to_pylist(), raws, gone, strict=True)], pa.string())}
            out |= {c: docs[c] for c in carried}
        if "many" in docs.column_names:
            out |= {c: docs[c] for c in ("many", "key", *_TEXT)}
        if not full:
            out["kept_sha256"] = pa.array([hashlib.sha256(b" ".join(words if not g.any() else [x for x, y in zip(words, g, strict=True) if not y])).hexdigest()
                                           for words, g in zip(split, gone, strict=True)])
        return pa.table(out)
    return run


def _without(raw: bytes, gone: np.ndarray) -> str:
    """The text without the marked words and the white space after each."""
    out, at = [], 0
    for m, drop in zip(_BYTES_WORD.finditer(raw), gone, strict=True):
        if drop:
            out.append(raw[at:m.start()])
            at = m.end()
            while at < len(raw) and raw[at] in b" \t\n\x0b\x0c\r":
                at += 1
    out.append(raw[at:])
    return b"".join(out).rstrip(b" \t\n\x0b\x0c\r").decode()


def phrases(d: DataFrame) -> DataFrame:
    """(shard, at, before, copy, d1, d2): the confirmed phrases every shard needs, and its copies' ids and digests; staged."""
    seeds = d.select("shard", "key", "text").mapInArrow(_seeds, _SEEDS)
    same = ["d1", "d2"]
    long_ = seeds.where(F.col("words") >= WINDOW).select("shard", "key", *same)
    firsts = long_.groupBy(*same).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    copies = staged(long_.join(firsts, same).where("key > lo").select("shard", F.col("key").alias("copy"), *same).distinct(), "copies")
    occurring = seeds.select("shard", "d1", F.explode("seeds").alias("seed"))
    recurring = staged(occurring.groupBy("seed").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("seed"), "seeds")
    release(d.sparkSession)
    none = F.lit(None).cast("long")
    no_copy = [none.alias(c) for c in ("copy", *same)]
    routed = staged(occurring.select("shard", "seed").join(recurring, "seed", "left_semi").select("shard", "seed", *no_copy)
                    .unionByName(copies.select("shard", none.alias("seed"), "copy", *same)), "routed")
    discard(recurring)
    windows = staged(d.select("shard", "key", "text").groupBy("shard").cogroup(routed.groupBy("shard")).applyInArrow(_candidates, _PHRASE), "windows")
    discard(routed)
    repeated = (windows.groupBy("h1", "h2").agg(F.min("first").alias("before"), F.max(F.coalesce("last", "first")).alias("latest"))
                .where("before < latest").select("h1", "h2", "before"))
    out = staged(windows.join(repeated, ["h1", "h2"]).where("coalesce(last, first) > before")
                 .select("shard", "at", "before", *no_copy)
                 .unionByName(copies.select("shard", F.lit(None).cast("int").alias("at"), none.alias("before"), "copy", *same)), "phrases")
    discard(windows, copies)
    return out


def remove_repeated(docs: DataFrame, full: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 for every row of ``docs``.

    ``full``: the remaining text (white space as in the input) instead of its digest, and the
    string columns named in ``carry``.
    """
    d = pick(docs, doc_id="long", text="string", **{c: "string" for c in carry})
    d = d.withColumns({"key": F.coalesce("doc_id", F.lit(_AFTER_ALL)), "t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})
    row = ["key", *_TEXT]
    many = staged(d.groupBy(*row).count().where(F.col("count") > SHARD_ROWS).select(*row), "many")
    if not many.limit(1).count():
        discard(many)
        return _judged(d, full, carry)
    # Equal rows have equal results: each such group is judged as one row among the others.
    alike = d.join(many, row, "left_semi")
    one = alike.groupBy(*row).agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text"))
    rest = d.join(many, row, "left_anti").withColumn("many", F.lit(False))
    one = one.withColumns({c: F.lit(None).cast("string") for c in carry}).withColumn("many", F.lit(True))
    out = staged(_judged(staged(rest.unionByName(one), "single"), full, carry), "judged")
    columns = [c for c in out.columns if c not in (*row, "many")]
    result = out.where("many").drop("many", "doc_id", *carry)
    return out.where("NOT many").select(*columns).unionByName(alike.drop("text").join(result, row).select(*columns))


def _judged(d: DataFrame, full: bool, carry: tuple[str, ...]) -> DataFrame:
    """The result for every row of ``d``, with the columns that name a row if it has ``many``."""
    shards = max(1, -(-d.count() // SHARD_ROWS))
    d = d.withColumn("shard", F.pmod(F.xxhash64("key", "t1"), F.lit(shards)))
    known = phrases(d)
    last = "text string" + "".join(f", {c} string" for c in carry) if full else "kept_sha256 string"
    if "many" in d.columns:
        last = "many boolean, key long, t1 long, t2 long, " + last
    else:
        d = d.drop("t1", "t2")
    return (d.groupBy("shard").cogroup(known.groupBy("shard"))
            .applyInArrow(_remove(list(carry), full), f"doc_id long, n_words long, n_removed long, {last}"))
