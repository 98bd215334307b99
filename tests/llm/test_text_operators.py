"""Operators over documents against brute force on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

import fixtures as X
from codeloom.llm import bpe, language_id, mixing, near_dedup, quality_classifier, quality_rules, repeated_phrases, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(t or "")


# --- operator 1 ---

def test_language_filter_reports_every_language_of_a_gram():
    rng = np.random.default_rng(1)
    grams = rng.integers(0, 1 << 63, 3_000, dtype=np.int64).astype(np.uint64)
    names = [f"l{i:03d}" for i in range(70)]            # more languages than one 64-bit word holds
    member = rng.random((3_000, 70)) < 0.1
    at, lang = np.nonzero(member)
    f = language_id.build_filter(names, grams[at], lang)
    count, total = language_id.counts_by_language(f, grams, np.arange(3_000), 3_000)
    assert (total == 1).all() and (count[member] > 0.99).all()
    foreign = rng.integers(0, 1 << 63, 20_000, dtype=np.int64).astype(np.uint64)
    count, _ = language_id.counts_by_language(f, foreign, np.zeros(20_000, np.int64), 1)
    assert (count[0] / 20_000 < 0.01).all()             # false positives are taken off


def test_language_id_held_out_and_awkward_rows(spark):
    rng = random.Random(3)
    data = [[i, X.sentence(rng, lang, 40), lang, "s"] for i in range(400) for lang in [rng.choice(["en", "de", "fr"])]]
    data += [[400, None, None, None], [401, "", None, None], [402, "12 -- 34", "en", None], [None, data[0][1], None, None], [0, *data[0][1:]]]
    out = language_id.language_id(X.frame(spark, data)).collect()
    assert len(out) == len(data)
    truth = {i: lang for i, _, lang, _ in data if i is not None and i < 400}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (400, 401, 402)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "fr", "und") for r in out)


def test_language_id_without_labels(spark):
    out = language_id.language_id(X.frame(spark, [[1, "some words", None, None]])).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)]


# --- operator 2 ---

def kept_words(data):
    first = {}
    rank = lambda i: math.inf if i is None else i
    for i, t, *_ in data:
        w = words(t)
        for p in range(len(w) - 12):
            g = tuple(w[p:p + 13])
            first[g] = min(first.get(g, math.inf), rank(i))
    out = []
    for i, t, *_ in data:
        w = words(t)
        gone = set()
        for p in range(len(w) - 12):
            if first[tuple(w[p:p + 13])] < rank(i):
                gone.update(range(p, p + 13))
        out.append((i, len(w), len(gone), [x for p, x in enumerate(w) if p not in gone]))
    return out


@pytest.mark.parametrize("shard_rows", [3, 64])
def test_repeated_phrases_equal_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(repeated_phrases, "SHARD_ROWS", shard_rows)
    data = X.rows()
    data += [[3, data[12][1], "en", "s"], [None, data[12][1], "en", "s"], [None, data[15][1], None, None]]    # repeated and null ids
    out = repeated_phrases.remove_repeated(X.frame(spark, data)).collect()
    want = sorted(((i is None, i or 0, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, g, k in kept_words(data)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    full = repeated_phrases.remove_repeated(X.frame(spark, data), full=True, carry=("lang",)).collect()
    assert sorted((r.doc_id or -1, words(r.text)) for r in full) == sorted((i or -1, k) for i, _, _, k in kept_words(data))
    texts = {i: t for i, t, *_ in data if i is not None and i != 3}
    assert all(r.text == texts[r.doc_id] for r in full if r.doc_id in texts and r.n_removed == 0)     # untouched texts stay as they are


def test_copies_are_single_texts_not_ids(spark):
    """A copy under a null or repeated id takes only its own text along."""
    rng = random.Random(21)
    base, unique, other = (X.sentence(rng, "en", 40) for _ in range(3))
    data = [[3, base, "en", "s"], [None, base, "en", "s"], [None, unique, "en", "s"], [None, "too short", "en", "s"], [None, None, "en", "s"],
            [5, base, "en", "s"], [5, other, "en", "s"], [9, "start " + other + " end", "en", "s"], [8, X.sentence(rng, "de", 30), "de", "s"]]
    out = repeated_phrases.remove_repeated(X.frame(spark, data)).collect()
    want = sorted((i is None, i or 0, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, g, k in kept_words(data))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert sorted(r.n_removed for r in out if r.doc_id in (None, 5)) == [0, 0, 0, 0, 40, 40]


def test_rows_of_one_id_are_dealt_to_many_shards(spark, monkeypatch):
    """A third of the rows under null, a third under one id, some of them equal: no shard holds more than its share, results stay."""
    monkeypatch.setattr(repeated_phrases, "SHARD_ROWS", 4)
    rng = random.Random(22)
    passage = X.sentence(rng, "en", 15)
    text = lambda i: X.sentence(rng, "en", 20) + (" " + passage if i % 5 == 0 else "") + " " + X.sentence(rng, "de", 3)
    data = [[i % 3 and (7 if i % 3 == 1 else 100 + i) or None, text(i), "en", "s"] for i in range(90)]
    data += [[None, data[0][1], "en", f"s{i}"] for i in range(20)] + [[200 + i, data[0][1], "en", "s"] for i in range(3)] + [[None, None, None, "s"]] * 20
    sizes, judged = [], repeated_phrases.phrases
    def watched(d):
        sizes.append(max(r["count"] for r in d.groupBy("shard").count().collect()))
        return judged(d)
    monkeypatch.setattr(repeated_phrases, "phrases", watched)
    out = repeated_phrases.remove_repeated(X.frame(spark, data)).collect()
    want = sorted(((i is None, i or 0, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for i, n, g, k in kept_words(data)))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    full = repeated_phrases.remove_repeated(X.frame(spark, data), full=True, carry=("source",)).collect()
    assert sorted((r.doc_id or -1, r.source, r.text is None, words(r.text)) for r in full) == sorted((i or -1, s, t is None, k) for (_, t, _, s), (i, _, _, k) in zip(data, kept_words(data), strict=True))
    assert max(sizes) <= 16


# --- operator 3 ---

@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    return P.path("byte_bpe_50k.json")


def test_bpe_equals_the_library(spark, vocabulary):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(vocabulary)
    rng = random.Random(5)
    alphabet = "aàbcd '\n\t0１٣²漢字😀é\u0301-_=<|>\u200b\x00\x1c\x85"
    parts = ["ing", "the", " ", "er", "re", "tion", "<|", "endoftext", "|>", "  ", "\n", "ab", "ba", "aa", "<|endoftext|>"]
    texts = ["", None, "a" * 20_000, " " * 3_000, "<|endoftext|>x<|endoftext|>", *[t for _, t, *_ in X.rows()]]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(400)]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(400)]
    data = [[i, t, None, None] for i, t in enumerate(texts)]
    out = {r.doc_id: r for r in bpe.encode(X.frame(spark, data), vocabulary).collect()}
    digests = {r.doc_id: r for r in bpe.encode_digests(X.frame(spark, data), vocabulary).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, dtype="<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False)
        assert bytes(out[i].ids) == raw and out[i].n_tokens == len(ids) and out[i].decoded == back == (t or "")
        assert digests[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert digests[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


def test_bpe_refuses_other_vocabularies(spark, vocabulary):
    with pytest.raises(ValueError):
        bpe.encode(X.empty(spark), vocabulary.replace("byte_bpe_50k", "word_bpe_49k"))


# --- operator 4 ---

def shingles(t):
    w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(data):
    sets = [(i, shingles(t)) for i, t, *_ in data if i is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1:]:
            if s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def test_near_dedup_equals_brute_force(spark):
    data = X.rows(seed=2, n=50)
    rng = random.Random(9)
    # chains: each link is close, the ends are not; and a group whose members all differ
    base = X.sentence(rng, "en", 200).split()
    for step in range(12):
        base = [*base[:step * 9], X.word(rng, "de"), *base[step * 9 + 1:]]
        data.append([len(data), " ".join(base), "en", "s"])
    data += [[len(data), data[0][1].upper(), "en", "s"], [5, data[5][1], "en", "s"]]
    out = near_dedup.near_dedup(X.frame(spark, [*data, [None, data[0][1], None, None]])).collect()
    want = groups(data)
    assert len(out) == len(data) + 1
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id]), r
    sizes = {i: len(shingles(t)) for i, t, *_ in data}
    assert all(r.n_shingles == sizes[r.doc_id] for r in out if r.doc_id is not None)


def test_near_dedup_rest_round_finds_links_that_leaders_miss(spark, monkeypatch):
    """Without any star every link must come from the last round."""
    monkeypatch.setattr(near_dedup, "_leader_pairs", lambda buckets, turn: buckets.select("doc_id", "doc_id").toDF("a", "b").limit(0))
    data = X.rows(seed=4, n=40)
    out = near_dedup.near_dedup(X.frame(spark, data)).collect()
    want = groups(data)
    assert all(r.component_id == want[r.doc_id] for r in out)


def _near_copies(rng, n, length=100, changes=2):
    """n texts of one base text with up to so many words changed: many pairs lie below the threshold, all are connected."""
    base = [f"w{i}" for i in range(length)]
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, changes)):
            words[rng.randrange(length)] = f"x{rng.randrange(10**6)}"
        out.append([i, " ".join(words), "en", "s"])
    return out


def test_near_dedup_forms_no_quadratic_pairs_in_one_group(spark, monkeypatch):
    counted = []
    verified = near_dedup._verified

    def counting(pairs, nodes, texts):
        counted.append(pairs.count())
        return verified(pairs, nodes, texts)

    monkeypatch.setattr(near_dedup, "_verified", counting)
    per_document = []
    for n in (400, 800):
        counted.clear()
        out = near_dedup.near_dedup(X.frame(spark, _near_copies(random.Random(2), n))).collect()
        assert len({r["component_id"] for r in out}) < n // 4
        per_document.append(sum(counted) / n)
        assert counted[-1] < n                      # what is left after the leader rounds
    assert per_document[1] < 40 and per_document[1] < 1.5 * per_document[0]


def test_near_dedup_judges_every_text_of_a_repeated_id(spark):
    """Both texts of id 1 lead near copies; each link is decided on its own text, whichever stands first."""
    rng = random.Random(23)
    first, second = X.sentence(rng, "en", 100), X.sentence(rng, "de", 100)
    data = [[1, first, "en", "s"], [1, second, "en", "s"], [2, first + " x", "en", "s"], [3, second + " x", "en", "s"], [4, X.sentence(rng, "fr", 100), "en", "s"]]
    for rows in (data, data[::-1]):
        out = near_dedup.near_dedup(X.frame(spark, rows, partitions=1)).collect()
        assert sorted((r.doc_id, r.component_id, r.kept) for r in out) == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]


def test_posterior_bound_follows_matches():
    least = [near_dedup.least_matches(n, 0.75) for n in (16, 64, 144)]
    assert least == sorted(least) and 0 < least[0] < 12 and least[2] < 108


# --- operator 5 ---

def mix_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: float(3 * sizes[s]) for s in capped}
        capped |= over


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_mixing_meets_targets(spark, block):
    data = X.rows()
    data += [[7, data[7][1], "en", data[7][3]], [None, "some words here", None, "s2"]]
    out = mixing.mix(X.frame(spark, data), block).collect()
    again = mixing.mix(X.frame(spark, data, partitions=7), block).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, out)) == sorted(map(key, again)) and len(out) == len(data)
    sizes, taken, source = collections.Counter(), collections.Counter(), {i: s for i, _, _, s in data}
    for i, t, _, s in data:
        sizes[s] += len(words(t))
    want = mix_targets(sizes)
    for r in out:
        s = source[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12) and 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in sizes)


def test_schedule_is_even_and_complete(spark):
    sources = spark.createDataFrame([(1, 50_000), (2, 20_001), (3, 0), (4, 9)], "position int, quota long")
    out = mixing.schedule(sources, 10).orderBy("slot").collect()
    want = {1: 5000, 2: 2001, 4: 1}
    assert [r.slot for r in out] == list(range(7002))
    assert all(sorted(r.block for r in out if r.position == p) == list(range(n)) for p, n in want.items())
    assert all([r.block for r in out if r.position == p] == list(range(n)) for p, n in want.items())      # ranked by slot
    seen = 0
    for i, r in enumerate(out, 1):
        seen += r.position == 1
        assert abs(seen - i * 5000 / 7002) < 6      # low discrepancy in every prefix


def test_mixed_documents_sum_to_taken(spark):
    data = X.rows()
    full = mixing.mixed_documents(X.frame(spark, data), 16, carry=("lang",)).collect()
    taken = {r.doc_id: r.taken for r in mixing.mix(X.frame(spark, data), 16).collect()}
    got = collections.Counter()
    for r in full:
        got[r.doc_id] += len(words(r.text))
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_mixture_lists_every_block_in_slot_order(spark):
    data = X.rows(n=40, long_words=500)
    d = X.frame(spark, data)
    rows = sorted(mixing.mixture(d, 16).collect(), key=lambda r: (r.slot, r.repeat, r.start))
    taken = collections.Counter()
    blocks = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r.first <= r.last < len(words(data[r.doc_id][1])) and r.source == data[r.doc_id][3]
        taken[r.doc_id] += r.last - r.first + 1
        blocks[r.slot, r.source, r.block] += r.last - r.first + 1
    assert {r.doc_id: r.taken for r in mixing.mix(d, 16).collect() if r.taken} == dict(taken)
    assert [s for s, *_ in blocks] == list(range(len(blocks))) and max(blocks.values()) == 16
    by_source = collections.defaultdict(list)
    for _, s, b in blocks:
        by_source[s].append(b)
    assert all(b == list(range(len(b))) for b in by_source.values()) and len({s for _, s, _ in list(blocks)[:12]}) > 2     # interleaved
    first = collections.defaultdict(lambda: math.inf)
    for r in rows:
        first[r.doc_id, r.repeat] = min(first[r.doc_id, r.repeat], r.slot)
    assert {(r.doc_id, r.repeat): r.slot for r in mixing.mixed_documents(d, 16).collect()} == dict(first)


# --- operators 7 and 9 ---

def test_toxicity_finds_misspellings(spark):
    rng = random.Random(6)
    bad = ["scoundrel", "blockhead", "numbskull"]
    data, labels = [], []
    for i in range(700):
        w = X.sentence(rng, "en", 60).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                x = rng.choice(bad)
                p = rng.randrange(len(x))
                w[rng.randrange(60)] = x[:p] + rng.choice("xzq0") + x[p + 1:]
        data.append([i, " ".join(w), "en", "s"])
        labels.append((i, None, int(toxic)))
    data += [[700, None, None, None], [701, "", None, None], [None, data[0][1], None, None], [0, *data[0][1:]]]
    labels += [(701, 1, None), (None, 1, 1), (9_999, 1, 0), (0, 1, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(X.frame(spark, data), marks).collect()
    assert len(out) == len(data) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    one = toxicity.toxicity(X.frame(spark, data), marks.where("toxic = 0")).collect()
    assert {r.predicted for r in one} == {0}


def test_quality_by_compression(spark):
    rng = random.Random(8)
    data, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        text = X.sentence(rng, "en", 80)
        if not good:
            text = " | ".join(w + "###" for w in text.split())
        data.append([i, text, "en", "s"])
        labels.append((i, int(good), None))
    data += [[400, None, None, None], [401, "", None, None], [0, *data[0][1:]]]
    marks = spark.createDataFrame([*labels, (0, 0, 1), (401, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.quality(X.frame(spark, data), marks).collect()
    held = [r for r in out if r.held_out and r.doc_id < 400]
    assert len(out) == len(data) and sum(r.predicted == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)
    assert {r.size_difference for r in out if r.doc_id in (400, 401)} == {0.0}
    assert {r.predicted for r in quality_classifier.quality(X.frame(spark, data), marks.where("quality = 1")).collect()} == {1}


def test_sample_has_one_row_an_id_and_bounded_heads(spark):
    from codeloom.llm.common import labelled_sample, pick
    data = [[i, f"text {i} " * (5_000 if i % 2 else 50), "en", "s"] for i in range(12)] + [[3, f"other {i}", "en", "s"] for i in range(200)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    samples = [labelled_sample(pick(X.frame(spark, data, partitions=n), doc_id="long", text="string"), marks, 100, seed=9)[0] for n in (2, 5)]
    got = [sorted((r.doc_id, r.text) for r in s.collect()) for s in samples]
    assert [i for i, _ in got[0]] == list(range(12)) and got[0] == got[1]
    most = 20_000
    of = quality_classifier.pieces(samples[0], most)
    text = {r["label"]: [] for r in samples[0].collect()}
    for r in samples[0].collect():
        text[r["label"]].append(r["text"].encode())
    for label, texts in text.items():
        every = [t[at:at + quality_classifier.PIECE] for t in texts for at in range(0, len(t), quality_classifier.PIECE)]
        assert set(of[label]) <= set(every) and sum(map(len, of[label])) < 2 * most
        if sum(map(len, texts)) <= most:
            assert sorted(of[label]) == sorted(every)


def test_dictionary_pieces_come_from_whole_long_texts(spark):
    long = [(i, "".join(f"{i:03d}{k:07d}" for k in range(20_000)), i % 2) for i in range(12)]
    rows = spark.createDataFrame(long, "doc_id long, text string, label int").repartition(3)
    of = quality_classifier.pieces(rows, 60_000)
    again = quality_classifier.pieces(rows.repartition(5), 60_000)
    assert of == again
    for label in (0, 1):
        assert 30_000 < sum(map(len, of[label])) < 90_000
        whole = {t.encode() for k, t, x in long if x == label}
        assert any(t.find(p) > len(t) * 0.8 for p in of[label] for t in whole)


# --- operator 10 ---

def counts(t):
    w = words(t)
    runs = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in (t or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(2)
    data = [*X.rows(), [200, "a b c d e " * 5, None, None], [201, "x y\nx y\n\n x y\nz", None, None], [202, "😀😀 # $$\u00a0b", None, None],
            [203, " ".join(rng.choice("ab") for _ in range(300)), None, None], [None, "a b", None, None], [4, "repeat", None, None]]
    out = quality_rules.quality_rules(X.frame(spark, data)).collect()
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out)
    assert got == collections.Counter((i, *counts(t)) for i, t, *_ in data)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out)
    assert all(not r.kept or not r.base_failed for r in out)


def test_cascade_order_changes_cost_not_verdict(spark):
    d = X.frame(spark, X.rows())
    names = [r.name for r in quality_rules.RULES]
    verdicts = [{(r.doc_id, r.kept) for r in quality_rules.quality_rules(d, order=o).collect()} for o in (names, names[::-1])]
    assert verdicts[0] == verdicts[1]
    measured = [("word_length", 1.0, 0.1), ("symbols", 0.1, 0.1), ("dup_lines", 1.0, 0.9), ("letters", 1.0, 0.0), ("capitals", 5.0, 0.2)]
    assert [r.name for r in quality_rules.plan(measured)] == ["symbols", "dup_lines", "word_length", "capitals", "letters"]


# --- empty tables ---

def test_empty_tables(spark, vocabulary):
    d = X.empty(spark)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (language_id.language_id(d), repeated_phrases.remove_repeated(d), bpe.encode_digests(d, vocabulary), near_dedup.near_dedup(d),
                mixing.mix(d), mixing.mixed_documents(d), toxicity.toxicity(d, marks), quality_classifier.quality(d, marks), quality_rules.quality_rules(d)):
        assert out.collect() == []
