"""V3 keyword leg: BM25 and BM25F over lower-cased letter/digit tokens.

score(q, d) = sum over query terms t of  qtf(t) * idf(t) * x * (k1 + 1) / (x + k1)
idf(t) = ln(1 + (N - n(t) + 0.5) / (n(t) + 0.5))

where x is the term's length-normalised frequency in the document,
tf / (1 - b + b * dl / avgdl).  With several fields (BM25F) x is the sum over fields of
boost * tf / (1 - b + b * dl / avgdl), each field with its own lengths, *before* it saturates, and
n(t) counts the documents that hold t in any field.

Only documents that contain a query term are scored; there is never a query x document
product.  All fields are tokenized in one scan.  A document is one row with the codes and frequencies of its query
terms, counted per Arrow batch; rows, not postings, are brought together by document id, and the sums per
(query, document) are made in the task that holds the row: pairs are not shuffled, a top-k above them sends only its
per-task winners.  The terms go to the tasks in chunks of queries of bounded bytes.
Statistics (N, avgdl, n(t)) are per collection, where a collection is the value of the ``by``
columns (e.g. snapshot_id).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sizing import MAX_BROADCAST_BYTES, spread
from ..functions.text import token_line, tokens
from ..session import cut_lineage

K1 = 1.2
B = 0.75
QUERY_BYTES = MAX_BROADCAST_BYTES   # of query terms sent to the tasks at once
_ROWS = 1024                        # documents whose words are counted at once in a task
_CELLS = 1 << 20                    # (document, query) sums, and four times as many addends, held at once in a task


def query_terms(queries: DataFrame, query_id: str, text: str,
                by: Sequence[str] = ()) -> DataFrame:
    """(by..., query_id, term, qtf): distinct terms with their count in the query."""
    return (queries
            .select(*by, query_id, F.explode(tokens(text)).alias("term"))
            .groupBy(*by, query_id, "term")
            .agg(F.count(F.lit(1)).alias("qtf")))


def term_rows(docs: DataFrame, fields: Sequence[str], doc_id: str, by: Sequence[str] = ()) -> DataFrame:
    """(by..., doc_id, dl, m, e): a row a document id and lengths, ``m`` documents; ``e`` has (term, tf) of every term of each.

    dl and tf are arrays over ``fields``.  One scan: words are counted per Arrow batch, rows, not terms, are exchanged.
    """
    keep = [*by, doc_id]
    lines = docs.select(*keep, *[token_line(f).alias(f"_t{i}") for i, f in enumerate(fields)])
    e = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.ArrayType(T.LongType()))]))
    counted = lines.mapInArrow(_words_fn(keep, len(fields)), T.StructType([*[lines.schema[c] for c in keep], T.StructField("dl", T.ArrayType(T.IntegerType())), T.StructField("e", e)]))
    return counted.groupBy(*keep, "dl").agg(F.count(F.lit(1)).alias("m"), F.flatten(F.collect_list("e")).alias("e"))


def posting_rows(rows: DataFrame, nf: int) -> DataFrame:
    """(by..., doc_id, dl, term, tf) of ``term_rows``; terms of several documents of one id and like lengths are added up."""
    keep = [c for c in rows.columns if c not in ("m", "e")]
    each = lambda d: d.select(*keep, F.explode("e").alias("e")).select(*keep, "e.term", "e.tf")
    several = each(rows.where(F.col("m") > 1)).groupBy(*keep, "term").agg(F.array(*[F.sum(F.get("tf", F.lit(i))) for i in range(nf)]).alias("tf"))
    return each(rows.where(F.col("m") == 1)).unionByName(several)


def normalised(tf: Column | str, dl: Column | str, avgdl: Column, boosts: Sequence[float], b: float = B) -> Column:
    """Sum over fields of boost * tf / (1 - b + b * dl / avgdl)."""
    at = lambda c, i: F.get(F.col(c) if isinstance(c, str) else c, F.lit(i))
    parts = [F.lit(float(w)) * at(tf, i) / (1 - b + b * at(dl, i) / F.when(F.get(avgdl, F.lit(i)) > 0, F.get(avgdl, F.lit(i))).otherwise(1.0))
             for i, w in enumerate(boosts)]
    return sum(parts[1:], parts[0])


def idf(n_docs: Column, n: Column) -> Column:
    return F.log(1 + (n_docs - n + 0.5) / (n + 0.5))


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Consecutive ``sizes`` of the values as a list column."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def _flat(c: pa.Array, width: int | None = None) -> np.ndarray:
    v = c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return v if width is None else v.reshape(-1, width)


def _count_fn(sent, keep: Sequence[str], nf: int, done: bool = False):
    """Rows (keep..., _c, _t0...) -> (keep..., _c, dl, codes, tf): a document's words that queries of its collection ask for.

    With ``done`` a row is a whole document, and gets ``held`` as behind ``_merge_fn``."""
    def run(batches):
        terms, asked = sent.value           # distinct terms; sorted collection * len(terms) + term, a code's place in it
        k = max(1, len(terms))
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                n = b.num_rows
                group = b.column("_c").to_numpy(zero_copy_only=False).astype(np.int64)
                dl, found = np.zeros((n, nf), dtype=np.int64), []
                for i in range(nf):
                    words = pc.split_pattern(b.column(f"_t{i}"), " ")
                    row, flat = pc.list_parent_indices(words).to_numpy(zero_copy_only=False), words.flatten()
                    dl[:, i] = np.bincount(row[pc.not_equal(flat, "").to_numpy(zero_copy_only=False)], minlength=n)
                    at = pc.fill_null(pc.index_in(flat, value_set=terms), -1).to_numpy(zero_copy_only=False)
                    row, at = row[at >= 0].astype(np.int64), at[at >= 0]
                    key = group[row] * k + at
                    code = np.searchsorted(asked, key)
                    ok = asked[np.minimum(code, len(asked) - 1)] == key if len(asked) else np.zeros(len(key), dtype=bool)
                    found.append(row[ok] * max(1, len(asked)) + code[ok])
                posting, inverse = np.unique(np.concatenate(found), return_inverse=True)
                tf, upto = np.zeros((len(posting), nf), dtype=np.int64), 0
                for i, f in enumerate(found):
                    tf[:, i], upto = np.bincount(inverse[upto:upto + len(f)], minlength=len(posting)), upto + len(f)
                row, code = np.divmod(posting, max(1, len(asked)))
                held = np.bincount(row, minlength=n)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], b.column("_c"), _lists(dl.ravel(), np.full(n, nf)), *([_lists(held, np.ones(n, np.int64))] if done else []),
                                                  _lists(code, held), _lists(tf.ravel(), held * nf)], names=[*keep, "_c", "dl", *(["held"] if done else []), "codes", "tf"])
    return run


def _words_fn(keep: Sequence[str], nf: int):
    """Rows (keep..., _t0...) -> (keep..., dl, e): every word of a document with its frequencies."""
    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, _ROWS):
                b = whole.slice(lo, _ROWS)
                n, dl, rows, flats = b.num_rows, np.zeros((b.num_rows, nf), dtype=np.int64), [], []
                for i in range(nf):
                    words = pc.split_pattern(b.column(f"_t{i}"), " ")
                    row, flat = pc.list_parent_indices(words), words.flatten()
                    full = pc.not_equal(flat, "")
                    rows.append(row.filter(full).to_numpy(zero_copy_only=False).astype(np.int64))
                    flats.append(flat.filter(full))
                    dl[:, i] = np.bincount(rows[i], minlength=n)
                words = pa.concat_arrays(flats).dictionary_encode()
                k = max(1, len(words.dictionary))
                held, inverse = np.unique(np.concatenate(rows) * k + words.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                tf, upto = np.zeros((len(held), nf), dtype=np.int64), 0
                for i, f in enumerate(rows):
                    tf[:, i], upto = np.bincount(inverse[upto:upto + len(f)], minlength=len(held)), upto + len(f)
                row, word = np.divmod(held, k)
                tfs = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1) * nf, pa.int32()), pa.array(tf.ravel(), pa.int64()))
                e = pa.StructArray.from_arrays([words.dictionary.take(pa.array(word)), tfs], names=["term", "tf"])
                ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], _lists(dl.ravel(), np.full(n, nf)), pa.ListArray.from_arrays(ends, e)], names=[*keep, "dl", "e"])
    return run


def _merge_fn(keep: Sequence[str], nf: int):
    """(keep..., _c, v) -> (keep..., _c, dl, held, codes, tf): the rows ``v`` of one id, those of like lengths added up.

    ``dl`` has ``nf`` lengths a row that is left, ``held`` its number of codes; codes and tf follow row by row.
    """
    def run(batches):
        for b in batches:
            n, rows = b.num_rows, b.column("v").flatten()
            doc = pc.list_parent_indices(b.column("v")).to_numpy(zero_copy_only=False)
            dl, code, tf = _flat(rows.field("dl"), nf), _flat(rows.field("codes")), _flat(rows.field("tf"), nf)
            of = np.repeat(np.arange(len(doc)), pc.list_value_length(rows.field("codes")).to_numpy(zero_copy_only=False))
            if len(doc) > n:
                one, place = np.unique(np.column_stack([doc, dl]), axis=0, return_inverse=True)
                doc, dl, of = one[:, 0], one[:, 1:], place.reshape(-1)[of]
                both, place = np.unique(np.column_stack([of, code]), axis=0, return_inverse=True)
                of, code = both[:, 0], both[:, 1]
                tf = np.column_stack([np.bincount(place.reshape(-1), weights=tf[:, i], minlength=len(both)).astype(np.int64) for i in range(nf)])
            held, rows_of = np.bincount(of, minlength=len(doc)), np.bincount(doc, minlength=n)
            codes_of = np.bincount(doc[of], minlength=n)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], b.column("_c"), _lists(dl.ravel(), rows_of * nf), _lists(held, rows_of),
                                              _lists(code, codes_of), _lists(tf.ravel(), codes_of * nf)], names=[*keep, "_c", "dl", "held", "codes", "tf"])
    return run


def _stats_fn(nf: int, collections: int, codes: int):
    """A task's (code, n, holds) of every code, and (-1 - collection, rows, sums of lengths)."""
    def run(batches):
        n, holds = np.zeros(codes, dtype=np.int64), np.zeros((codes, nf), dtype=np.int64)
        rows, sums = np.zeros(collections, dtype=np.int64), np.zeros((collections, nf), dtype=np.int64)
        for b in batches:
            code, tf, dl = _flat(b.column("codes")), _flat(b.column("tf"), nf), _flat(b.column("dl"), nf)
            group = b.column("_c").to_numpy(zero_copy_only=False).astype(np.int64)[pc.list_parent_indices(b.column("held")).to_numpy(zero_copy_only=False)]
            n += np.bincount(code, minlength=codes)
            np.add.at(rows, group, 1)
            for i in range(nf):
                holds[:, i] += np.bincount(code[tf[:, i] > 0], minlength=codes)
                np.add.at(sums[:, i], group, dl[:, i])
        some, seen = np.flatnonzero(n), np.flatnonzero(rows)
        yield pa.record_batch({"code": pa.array(np.concatenate([some, -1 - seen]), pa.int64()), "n": pa.array(np.concatenate([n[some], rows[seen]]), pa.int64()),
                               **{f"n{i}": pa.array(np.concatenate([holds[some, i], sums[seen, i]]), pa.int64()) for i in range(nf)}})
    return run


def slabs(value, b: pa.RecordBatch, nf: int, per_term):
    """(lo, hi, collection of each, scores, which are): the batch's documents from lo to hi, a cell each of their collection's queries."""
    start, place, qtf, _, _, width, n_docs, avgdl, n, holds = value
    many = np.diff(start)
    code, tf = _flat(b.column("codes")), _flat(b.column("tf"), nf)
    dl = np.repeat(_flat(b.column("dl"), nf), _flat(b.column("held")), axis=0)
    row = pc.list_parent_indices(b.column("codes")).to_numpy(zero_copy_only=False)
    group = b.column("_c").to_numpy(zero_copy_only=False).astype(np.int64)
    of = group[row]
    worth = per_term(tf, dl, avgdl[of], n_docs[of], n[code], holds[code])
    times = many[code]
    cost = np.bincount(row, weights=times, minlength=b.num_rows)
    lo, ends = 0, np.searchsorted(row, np.arange(b.num_rows + 1))
    upto = np.concatenate([[0], np.cumsum(cost)])
    while lo < b.num_rows:
        # Documents whose sums and addends fit, one at least.
        hi = max(lo + 1, min(lo + max(1, _CELLS // width), int(np.searchsorted(upto, upto[lo] + 4 * _CELLS, side="right")) - 1))
        p = slice(ends[lo], ends[hi])
        t = times[p]
        at = np.repeat(start[code[p]] - np.concatenate([[0], np.cumsum(t)[:-1]]), t) + np.arange(int(t.sum()))
        cell = np.repeat((row[p] - lo) * width, t) + place[at]
        score = np.bincount(cell, weights=np.repeat(worth[p], t) * qtf[at], minlength=(hi - lo) * width)
        met = np.zeros(len(score), dtype=bool)
        met[cell] = True
        yield lo, hi, group[lo:hi], score, met
        lo = hi


def _score_fn(sent, by: Sequence[str], doc_id: str, names: Sequence[str], nf: int, per_term):
    """(by..., query_id, doc_id, kw_score) of each document row, over the query terms sent."""
    def run(batches):
        ids, first, width = sent.value[3:6]
        for b in batches:
            for lo, _, group, score, met in slabs(sent.value, b, nf, per_term):
                r, q = np.divmod(np.flatnonzero(met), width)
                if len(r):
                    docs = pa.array(r + lo)
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(docs) for c in by], ids.take(pa.array(first[group[r]] + q)), b.column(doc_id).take(docs),
                                                      pa.array(score[met], pa.float64())], names=list(names))
    return run


def chunks_of(qt: DataFrame, by: Sequence[str]) -> int:
    """How many parts of at most QUERY_BYTES the query terms make."""
    size = sum([F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in ["term", *by]], F.lit(48)).cast("long")
    return max(1, -(-(qt.agg(F.sum(size)).first()[0] or 0) // QUERY_BYTES))


def _query_chunks(qt: DataFrame, by: Sequence[str], query_id: str) -> list[DataFrame]:
    """The query terms in parts of bounded bytes; a query is in one."""
    chunks = chunks_of(qt, by)
    if chunks == 1:
        return [qt]
    return [qt.where(F.pmod(F.xxhash64(*by, query_id), F.lit(chunks)) == i) for i in range(chunks)]


def _scored(docs: DataFrame, queries: DataFrame, fields: Sequence[str], per_term, *, doc_id: str, query_id: str, query_text: str,
            by: Sequence[str]) -> DataFrame:
    """(by..., query_id, doc_id, kw_score): the sums of ``per_term(tf, dl, avgdl, n_docs, n, holds)`` over matching terms."""
    by = list(by)
    chunks = _query_chunks(cut_lineage(query_terms(queries, query_id, query_text, by)), by, query_id)
    return functools.reduce(DataFrame.unionByName, [_counted(docs, qt, fields, per_term, doc_id, query_id, by).pairs() for qt in chunks])


@dataclass(frozen=True)
class Counted:
    """Documents with the frequencies of their query terms, and what is sent to the tasks to score them."""

    rows: DataFrame             # checkpointed: (by..., doc_id[, vec], _c, dl, held, codes, tf)
    sent: Broadcast
    held: list[tuple]           # the collections by number
    schema: T.StructType        # of pairs
    nf: int
    per_term: Callable
    by: list[str]
    doc_id: str

    def pairs(self) -> DataFrame:
        """(by..., query_id, doc_id, kw_score) of every document and query that share a term."""
        return self.rows.mapInArrow(_score_fn(self.sent, self.by, self.doc_id, self.schema.names, self.nf, self.per_term), self.schema)


def _counted(docs: DataFrame, qt: DataFrame, fields: Sequence[str], per_term, doc_id: str, query_id: str, by: list[str],
             vec: str | None = None, also: DataFrame | None = None) -> Counted:
    """The documents counted for query terms that fit QUERY_BYTES.

    The counted rows are checkpointed, so the statistics and scores read them instead of the text; everything sent to
    the tasks is at most as large as the query terms.  With ``vec``, a column of ``docs``, the rows carry it; a document id
    is then one row, and rows are not exchanged.  ``also`` has collections (by...) that count beside those of the terms.
    """
    spark, nf, keep = docs.sparkSession, len(fields), [*by, doc_id, *([vec] if vec else [])]
    held = [()]
    # Collections, queries and terms by number: a code is a collection's term, a collection's queries are consecutive.
    if by:
        asking = qt.select(*by) if also is None else qt.select(*by).unionByName(also.select(*by))
        held = [tuple(r) for r in asking.dropna().distinct().collect()]
        numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(held)], T.StructType([*[qt.schema[c] for c in by], T.StructField("_c", T.IntegerType())]))
        collections, numbers = max(1, len(held)), lambda d: d.join(F.broadcast(numbered), by)
    else:
        collections, numbers = 1, lambda d: d.withColumn("_c", F.lit(0))
    asked = numbers(qt).select("_c", F.col(query_id).alias("q"), "term", "qtf").toArrow().combine_chunks()
    group = asked.column("_c").to_numpy().astype(np.int64)
    terms = pa.array(asked.column("term").unique(), pa.string())
    term = pc.index_in(asked.column("term"), value_set=terms).to_numpy().astype(np.int64)
    codes, code = np.unique(group * max(1, len(terms)) + term, return_inverse=True)
    q = pa.concat_arrays(asked.column("q").chunks or [pa.array([], asked.schema.field("q").type)]).dictionary_encode(null_encoding="encode")
    both, query = np.unique(np.column_stack([group, q.indices.to_numpy()]), axis=0, return_inverse=True)
    ids, first = q.dictionary.take(pa.array(both[:, 1], pa.int64())), np.searchsorted(both[:, 0], np.arange(collections + 1))
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(codes) + 1))
    place, qtf = (query.reshape(-1) - first[group])[order], asked.column("qtf").to_numpy()[order].astype(np.float64)
    width = max(1, int(np.diff(first).max()))

    d = spread(docs.select(*keep, *fields), doc_id).select(*keep, *[token_line(f).alias(f"_t{i}") for i, f in enumerate(fields)])
    d = numbers(d)          # a document whose collection no query searches has no part
    given = [docs.schema[c] for c in keep]
    ints = lambda *cs: [T.StructField(c, T.ArrayType(T.IntegerType())) for c in cs]
    number = T.StructField("_c", T.IntegerType())
    vocabulary = spark.sparkContext.broadcast((terms, codes))
    whole = T.StructType([*given, number, *ints("dl", "held", "codes", "tf")])
    if vec:
        rows = cut_lineage(d.mapInArrow(_count_fn(vocabulary, keep, nf, True), whole))
    else:
        counted = d.mapInArrow(_count_fn(vocabulary, keep, nf), T.StructType([*given, number, *ints("dl", "codes", "tf")]))
        grouped = counted.groupBy(*keep, "_c").agg(F.collect_list(F.struct("dl", "codes", "tf")).alias("v"))
        rows = cut_lineage(grouped.mapInArrow(_merge_fn(keep, nf), whole))
    vocabulary.destroy()

    stats = (rows.select("_c", "dl", "held", "codes", "tf").mapInArrow(_stats_fn(nf, collections, len(codes)), "code long, n long, " + ", ".join(f"n{i} long" for i in range(nf)))
             .groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(nf)]).toArrow())
    at = stats.column("code").to_numpy()
    n = np.zeros((collections + len(codes), 1 + nf), dtype=np.int64)
    n[np.where(at < 0, -1 - at, collections + at)] = np.column_stack([stats.column(c).to_numpy() for c in ["n", *[f"n{i}" for i in range(nf)]]])
    n_docs = n[:collections, 0]
    avgdl = n[:collections, 1:] / np.maximum(n_docs, 1)[:, None]
    sent = spark.sparkContext.broadcast((start, place, qtf, ids, first, width, n_docs, avgdl, n[collections:, 0], n[collections:, 1:]))
    schema = T.StructType([*[docs.schema[c] for c in by], T.StructField(query_id, qt.schema[query_id].dataType), docs.schema[doc_id], T.StructField("kw_score", T.DoubleType())])
    return Counted(rows, sent, held, schema, nf, per_term, by, doc_id)


def _x(tf: np.ndarray, dl: np.ndarray, avgdl: np.ndarray, boosts: Sequence[float], b: float) -> np.ndarray:
    """``normalised`` of arrays (posting, field)."""
    return sum(float(w) * tf[:, i] / (1 - b + b * dl[:, i] / np.where(avgdl[:, i] > 0, avgdl[:, i], 1.0)) for i, w in enumerate(boosts))


def _idf(n_docs: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.log(1 + (n_docs - n + 0.5) / (n + 0.5))


def _bm25f_term(boosts: Sequence[float], k1: float, b: float):
    def per_term(tf, dl, avgdl, n_docs, n, holds):
        x = _x(tf, dl, avgdl, boosts, b)
        return _idf(n_docs, n) * x * (k1 + 1) / (x + k1)
    return per_term


def bm25f(docs: DataFrame, queries: DataFrame, fields: dict[str, float], *, doc_id: str = "doc_id", query_id: str = "query_id",
          query_text: str = "text", by: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(by..., query_id, doc_id, kw_score): BM25F over the text columns ``fields`` (name -> boost)."""
    return _scored(docs, queries, list(fields), _bm25f_term(list(fields.values()), k1, b), doc_id=doc_id, query_id=query_id, query_text=query_text, by=by)


def bm25f_counted(docs: DataFrame, terms: DataFrame, fields: dict[str, float], *, doc_id: str, query_id: str, by: Sequence[str], vec: str,
                  also: DataFrame, k1: float = K1, b: float = B) -> Counted:
    """The documents of ``bm25f`` with their vectors ``vec``, counted for these ``query_terms``; see ``_counted``."""
    return _counted(docs, terms, list(fields), _bm25f_term(list(fields.values()), k1, b), doc_id, query_id, list(by), vec, also)


def bm25(docs: DataFrame, queries: DataFrame, *, doc_id: str = "doc_id",
         doc_text: str = "text", query_id: str = "query_id",
         query_text: str = "text", by: Sequence[str] = (),
         k1: float = K1, b: float = B) -> DataFrame:
    """(by..., query_id, doc_id, kw_score) for every document matching a query term: BM25F of one field."""
    return bm25f(docs, queries, {doc_text: 1.0}, doc_id=doc_id, query_id=query_id, query_text=query_text, by=by, k1=k1, b=b)


def bm25_fields(docs: DataFrame, queries: DataFrame, fields: dict[str, float], *, doc_id: str = "doc_id",
                query_id: str = "query_id", query_text: str = "text", by: Sequence[str] = (), k1: float = K1, b: float = B) -> DataFrame:
    """(by..., query_id, doc_id, kw_score): the sum of separate BM25 scores of several text columns times their boosts.

    Each field saturates by itself and has its own document frequencies.  One scan and one sum, as ``bm25f``.
    """
    boosts = list(fields.values())

    def per_term(tf, dl, avgdl, n_docs, n, holds):
        xs = [_x(tf[:, [i]], dl[:, [i]], avgdl[:, [i]], [1.0], b) for i in range(len(boosts))]
        return sum(float(w) * _idf(n_docs, holds[:, i]) * x * (k1 + 1) / (x + k1) for i, (w, x) in enumerate(zip(boosts, xs, strict=True)))
    return _scored(docs, queries, list(fields), per_term, doc_id=doc_id, query_id=query_id, query_text=query_text, by=by)
