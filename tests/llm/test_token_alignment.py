"""Operator 11 against a plain alignment of whole texts by the libraries."""

import collections
import hashlib
import itertools
import json

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import fixtures as X
from codeloom.llm import token_alignment as T
from codeloom.llm.bpe import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_A = Tokenizer.from_file(A)
_A.encode_special_tokens = True
_B = sentencepiece.SentencePieceProcessor(model_file=B)
_BYTE = byte_alphabet()
with open(A, encoding="utf-8") as _f:
    _NAMES = {i: t for t, i in json.load(_f)["model"]["vocab"].items()}


def plain(text):
    """Groups of one text: lists of A ids and of B ids."""
    if not text:
        return []
    ids_a, ids_b = _A.encode(" " + text, add_special_tokens=False).ids, _B.encode(text)
    spell_a = [bytes(_BYTE[c] for c in _NAMES[i]) for i in ids_a]
    spell_b = [bytes([int(_B.id_to_piece(i)[3:5], 16)]) if _B.is_byte(i) else _B.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not (b"".join(spell_a) == b"".join(spell_b) == (" " + text).encode()):
        return []
    ends_a, ends_b = (list(itertools.accumulate(map(len, s))) for s in (spell_a, spell_b))
    cuts = set(ends_a) & set(ends_b)
    out, i, j = [], 0, 0
    for c in sorted(cuts):
        x, y = i, j
        while i < len(ids_a) and ends_a[i] <= c:
            i += 1
        while j < len(ids_b) and ends_b[j] <= c:
            j += 1
        out.append((ids_a[x:i], ids_b[y:j]))
    return out


def brute(data):
    groups = [(i, plain(t)) for i, t in data]
    pairs = [collections.Counter(p for a, b in g for p in itertools.product(a, b)) for _, g in groups]
    held = collections.Counter(p for c in pairs for p in c)
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (i, g), c in zip(groups, pairs, strict=True):
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(c.values()),
                    sum(n for p, n in c.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in c.items()),
                    hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(rows):
    return sorted([tuple(r[c] for c in COLUMNS) for r in rows.collect()], key=str)


ODD = ["a▁b", "<s> </s> <unk>", "x <|endoftext|> y", "  two  spaces  ", "\n\nlines\n \n", "tab\tand\r\n", "中文字符 日本語", "\U0001f600\U0001f468‍\U0001f469‍\U0001f467 ok",
       "\x00nul\x00", "\x1c\x1d a", "é é", " nbsp here", "'re we'll don't", "1234567890 " * 3, " ", "\n", "ﬁ ① ½", "İ ẞ ſ", "<0x41>"]


def test_awkward_rows_against_brute_force(spark, monkeypatch):
    data = [(i, t) for i, t, _, _ in X.rows(long_words=3_000)]
    data += [(1_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (3, "a repeated id"), (3, "a repeated id")]
    rows = X.frame(spark, [(i, t, "en", "s") for i, t in data], partitions=5)
    assert got(T.align(rows, A, B)) == brute(data)


def test_small_blocks_slabs_and_lanes_give_the_same(monkeypatch):
    rng_rows = [t for _, t, _, _ in X.rows(seed=5, long_words=2_000) if t]
    monkeypatch.setattr(T, "SLAB_BYTES", 700)
    monkeypatch.setattr(T, "LANE", 40)
    t = T._of_files(A, B)
    block = T._Block(t)
    for i, text in enumerate(rng_rows):
        block.add(i, text)
    row = block.row().to_pylist()[0]
    for i, text in enumerate(rng_rows):
        g = plain(text)
        said = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        assert (row["n_a"][i], row["n_groups"][i], row["n_links"][i]) == (sum(len(a) for a, _ in g), len(g), sum(len(a) * len(b) for a, b in g))
        assert row["groups_sha256"][i] == hashlib.sha256(said.encode()).hexdigest()
    places, times = np.cumsum(T._from_planes(row["places"])), T._from_planes(row["times"])
    at = 0
    for i, text in enumerate(rng_rows):
        want = collections.Counter(p for a, b in plain(text) for p in itertools.product(a, b))
        n = row["held"][i]
        have = {(row["keys"][p] >> 32, row["keys"][p] & 0xFFFFFFFF): int(x) for p, x in zip(places[at:at + n], times[at:at + n], strict=True)}
        assert have == dict(want)
        at += n


def test_groups_with_very_many_links():
    # Made-up ends: one document whose only common end is the last one.
    n = 300
    ends_a, ends_b = np.arange(1, n + 1) * 2, np.arange(1, 2 * n // 2 + 1) * 2 - 1
    ends_b[-1] = ends_a[-1]
    groups, (x, y) = T.lockstep(ends_a, ends_b, np.array([0, n]), np.array([0, len(ends_b)]))
    assert len(groups[0]) == 1 and len(x) == 0
    ids_a, ids_b = np.arange(n) % 3, np.arange(len(ends_b)) % 5
    codes, times = T._wide_links(groups, ids_a, ids_b, np.zeros(n, int), lambda d, x, y: (d * 3 + x) * 5 + y)
    code, times = T._summed(np.concatenate(codes), np.concatenate(times))
    want = collections.Counter((int(a), int(b)) for a in ids_a for b in ids_b)
    assert {(int(p) // 5, int(p) % 5): int(t) for p, t in zip(code, times, strict=True)} == want


def test_every_plain_character_beside_words_signs_and_spaces():
    for c in map(chr, range(1, 0x180)):
        for text in (f"a{c}b", f"{c} !", f"?{c}{c}1", f" {c}'s  {c}", f"9{c}9 A{c} ", f"\n{c}x"):
            assert T.aligned_text(text, A, B) == plain(text), text


PARTS = st.sampled_from([*"aZé ßЖ中\n\t\r'.!?0 ▁‍", "  ", " the", "ing", "\U0001f600", "<|endoftext|>", "'re", "<s>", "x" * 9])


@settings(max_examples=500, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_one_text(text):
    assert T.aligned_text(text, A, B) == plain(text)


def test_empty_table_and_pair_counts(spark):
    assert got(T.align(X.empty(spark), A, B)) == []
    rows = spark.createDataFrame([(1, "one two"), (2, "one"), (2, "one")], "doc_id long, text string")
    counts = {(r["id_a"], r["id_b"]): (r["n"], r["best"]) for r in T.pair_counts(rows, A, B).collect()}
    (a, b), = [(x, y) for x, y in plain("one")]
    assert counts[a[0], b[0]] == (3, True)


def test_query_over_its_whole_table(spark):
    from codeloom.llm.queries import op11_token_alignment
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert got(op11_token_alignment(spark, sf)) == brute(docs)


def test_blocks_rows_stay_small_and_give_the_same(spark, monkeypatch):
    data = [(i, t) for i, t, _, _ in X.rows(seed=7, long_words=600)]
    block = T._Block(T._of_files(A, B))
    for i, text in data:
        block.add(i, text)
    whole = block.row()
    small = list(block.rows(5, 200))
    most = max(whole["held"][0].as_py())
    assert len(small) > 5 and sum(len(r["keys"][0]) for r in small) == len(whole["keys"][0])
    for r in small:
        assert len(r["keys"][0]) <= 200 and sum(r["held"][0].as_py()) <= 200 + most and r["block"].to_pylist() == [5]
        assert len(r["places"][0].as_py()) < 3 * sum(r["held"][0].as_py()) + 2        # no eight bytes a pair
    for c in ("doc_id", "held", "groups_sha256", "keys", "holders"):
        assert [x for r in small for x in r[c][0].as_py()] == whole[c][0].as_py()
    x = np.array([0, -1, 127, -128, 128, 1 << 40, -(1 << 40), (1 << 63) - 1, -(1 << 63)])
    for n in range(len(x) + 1):
        assert T._from_planes(T._planes(x[:n])).tolist() == x[:n].tolist()


def test_blocks_of_several_rows_over_a_table(spark):
    words = [f"{a}{b}" for a in "qwrtzpsdfg" for b in ("ala", "ork", "ist", "enu")]
    data = [(i, " ".join(f"{w}{(i * 31 + k * 7) % 997} {chr(0x430 + (i + k) % 32)}" for k, w in enumerate(words))) for i in range(400)]
    rows = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    blocks = T._aligned_blocks(rows, A, B)
    sizes = blocks.selectExpr("block", "size(keys) AS n", "aggregate(held, 0L, (a, x) -> a + x) AS pairs").collect()
    assert len({r["block"] for r in sizes}) == 1 and len(sizes) > 1
    assert max(r["n"] for r in sizes) <= T.ROW_PAIRS and max(r["pairs"] for r in sizes) < 2 * T.ROW_PAIRS
    assert got(T.align(rows, A, B)) == brute(data)
