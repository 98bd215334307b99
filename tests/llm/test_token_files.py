"""Operator 12: files of token ids against the library, whole texts."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import fixtures as X
from codeloom.llm import token_files as T

WORDS_49K, BYTES_50K = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def _spec(path):
    with open(path, encoding="utf-8") as f:
        return f.read()


def expected(data, path=WORDS_49K, end_id=2):
    """{(doc_id, start): (ids)} in document order; rows of one id may come in either order."""
    tok = T.plain_tokenizer(_spec(path))
    return [(i, np.array([*tok.encode(t or "", add_special_tokens=False).ids, end_id], dtype="<u4").tobytes()) for i, t in data]


def check(got, data, path=WORDS_49K, end_id=2):
    got = sorted(got, key=lambda r: r["start"])
    start = 0
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4 and r["ids_crc32"] == zlib.crc32(r["ids"])
        start += r["n_tokens"]
    want = expected(data, path, end_id)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted([(r["doc_id"], bytes(r["ids"])) for r in got], key=key) == sorted(want, key=key)
    order = [(r["doc_id"] is None, r["doc_id"] or 0) for r in got]
    assert order == sorted(order)


def test_awkward_rows_and_clashing_columns(spark):
    data = [(i, t) for i, t, _, _ in X.rows()]
    data += [(None, "null id"), (None, "null id"), (None, None), (5, "another text of document five"), (5, "another text of document five"), (-3, "negative"), (1 << 60, "large")]
    rows = X.frame(spark, [(i, t, "en", "s") for i, t in data], partitions=5)
    folder = T.write_tokens(rows, WORDS_49K, part_bytes=2_000)
    files = T.TokenFiles.open(spark, folder)
    assert len(files.index["parts"]) > 4 and files.index["dtype"] == "<u2"
    got = T.read_tokens(spark, folder).collect()
    check(got, data)
    by_start = sorted(got, key=lambda r: r["start"])
    for i in (0, 7, len(got) - 1):
        doc_id, start, ids = files.document(i)
        assert (doc_id, start, ids.astype("<u4").tobytes()) == (by_start[i]["doc_id"], by_start[i]["start"], bytes(by_start[i]["ids"]))


def test_other_vocabulary_end_id_and_folder(spark, scratch):
    data = [(i, t) for i, t, _, _ in X.rows(n=40, long_words=500)]
    rows = X.frame(spark, [(i, t, "en", "s") for i, t in data], partitions=3)
    assert not T.drops_spaces(_spec(BYTES_50K)) and T.drops_spaces(_spec(WORDS_49K))
    folder = T.write_tokens(rows, BYTES_50K, folder=f"file://{scratch}/ids", end_id=70_000)
    assert T.TokenFiles.open(spark, folder).index["dtype"] == "<u4"
    check(T.read_tokens(spark, folder).collect(), data, BYTES_50K, 70_000)


def test_a_hot_id_is_spread_over_parts(spark):
    data = [(7, f"text number {i % 3} of one id") for i in range(3_000)] + [(i, "x") for i in range(100)]
    rows = X.frame(spark, [(i, t, "en", "s") for i, t in data], partitions=6)
    folder = T.write_tokens(rows, WORDS_49K, part_bytes=5_000)
    parts = T.TokenFiles.open(spark, folder).index["parts"]
    assert max(p["docs"] for p in parts) < 1_000
    check(T.read_tokens(spark, folder).collect(), data)


def test_files_of_failed_attempts_do_not_count(spark, scratch):
    (lambda f: (f.write(b"junk"), f.close()))(T.create(f"{scratch}/t/part-of-a-lost-task.ids"))
    folder = T.write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), WORDS_49K, folder=f"{scratch}/t")
    import os
    names = set(os.listdir(f"{scratch}/t")) - {x for x in os.listdir(f"{scratch}/t") if x.endswith(".crc")}
    assert "part-of-a-lost-task.ids" not in names and len(names) == 4
    check(T.read_tokens(spark, folder).collect(), [(1, "a b")])
    assert json.loads(T.read_text(spark, f"{folder}/index.json"))["end_id"] == 2


def test_empty_table_and_missing_column(spark):
    folder = T.write_tokens(X.empty(spark), WORDS_49K)
    assert T.read_tokens(spark, folder).collect() == []
    with pytest.raises(ValueError):
        T.write_tokens(spark.createDataFrame([(1,)], "doc_id long"), WORDS_49K)


ALPHABET = st.sampled_from(list("aAÉéß ΣσςİIı̸́<=>'std09٠!?-#\n\t\r\x0b\x0c\x1c\x1f\x85   　​İ中文\U0001f600|") + ["<|endoftext|>", "'re", "ll", "<|EndOfText|>", "!?", "&&&", "Word", "12", "…", "“"])


@settings(max_examples=600, deadline=None)
@given(st.lists(ALPHABET, max_size=30).map("".join))
def test_encoding_by_runs_is_the_librarys(text):
    global _ENCODER
    if "_ENCODER" not in globals():
        _ENCODER = T.Encoder(_spec(WORDS_49K), "<u2")
    assert _ENCODER.by_runs
    assert _ENCODER.encode(text.encode()) == _ENCODER._ids(text)
    assert _ENCODER.encode(text.upper().encode()) == _ENCODER._ids(text.upper())


def test_query_reads_back_its_whole_table(spark):
    from codeloom.llm.queries import op12_token_files
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, start = {}, 0
    for i, ids in sorted(expected(docs)):
        want[i] = (start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op12_token_files(spark, sf).collect()} == want


def test_every_plain_character_in_words_and_signs():
    e = T.Encoder(_spec(WORDS_49K), "<u2")
    for c in map(chr, range(1, 0x180)):
        for text in (f"a{c}b", f"{c}!", f"?{c}", f"{c}'s {c}", f"9{c}9 A{c}"):
            assert e.encode(text.encode()) == e._ids(text), text
