"""Exact byte-pair encoding by per-prefix dynamic programming, and decoding (operator 3).

Two adjacent tokens are compatible if byte-pair merging of their joined bytes never merges
across their border.  A token sequence is the encoding of its bytes exactly if every token
encodes to itself and every adjacent pair is compatible.  So for each prefix of a word there
is one last token: among the tokens that are suffixes of the prefix (found for all prefixes
in one pass of an automaton over the vocabulary), the one that spells the prefix alone or is
compatible with the last token of the prefix before it.  Following these back from the word's
end gives the ids, in time linear in the word's length.

Compatibility is decided on the two tokens' merge trees: the parts of the left token that end
at the border and the parts of the right token that begin there live for a span of merge
ranks; a border merge happens if its rank comes before the next own merge on either side (of
equal ranks the leftmost goes first).

The vocabulary is a ``tokenizers`` JSON file of a byte-level BPE without normaliser, read on
the driver and sent to the workers (a bounded size: the file).  Texts are encoded whole, as
``Tokenizer.encode(text, add_special_tokens=False)``: special tokens written in a text are
found first.  Encodings of short words are kept per worker in a table of bounded size.

Cases: null is encoded as the empty text (no tokens, empty decoded text); repeated rows are
encoded each by itself; a word as long as its document costs time in proportion; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import pick, text_slices

# Fixed value: the word pattern of byte-level BPE vocabularies.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 250_000
CACHED_PAIRS = 500_000
CACHED_LENGTH = 48
_NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """A vocabulary with its merges, ready to encode and decode."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") \
                or not pre.get("use_regex", True) or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("only byte-level BPE vocabularies without normaliser, prefix space and byte fallback are supported")
        as_byte = byte_alphabet()
        self.vocab = {bytes(as_byte[c] for c in token): i for token, i in model["vocab"].items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.added = added
        size = 1 + max([*self.vocab.values(), *added.values()])
        self.spelling = [b""] * size
        for token, i in self.vocab.items():
            self.spelling[i] = token
        for token, i in added.items():
            self.spelling[i] = token.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}     # token -> (left part, right part, rank of the merge)
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = model["vocab"][left], model["vocab"][right]
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(model["vocab"][left + right], (a, b, r))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.word_pattern = regex.compile(WORDS)
        self._pairs: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self._whole: dict[int, bool] = {}
        self.words = _WordTable(self)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Parts of the token at its left (0) or right (1) border, smallest first, each with the rank of its next merge."""
        have = self._spines[side].get(token)
        if have is None:
            have, above, t = [], _NEVER, token
            while True:
                have.append((t, above))
                cut = self.parts.get(t)
                if cut is None:
                    break
                t, above = cut[side], cut[2]
            have.reverse()
            self._spines[side][token] = have
        return have

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together leaves the border between them alone."""
        key = a << 32 | b
        known = self._pairs.get(key)
        if known is None:
            ends, begins = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            known = True
            while True:
                (x, x_next), (y, y_next) = ends[i], begins[j]
                r = self.rank.get((x, y))
                if r is not None and r < x_next and r <= y_next:
                    known = False
                    break
                if x_next == y_next == _NEVER:
                    break
                if x_next <= y_next:
                    i += 1
                else:
                    j += 1
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            self._pairs[key] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether the token's own bytes merge into it: its parts do, and nothing between them merges earlier."""
        known = self._whole.get(token)
        if known is None:
            cut = self.parts.get(token)
            known = len(self.spelling[token]) == 1 if cut is None else (
                self.whole(cut[0]) and self.whole(cut[1]) and self._meets(cut[0], cut[1], cut[2]))
            self._whole[token] = known
        return known

    def _meets(self, a: int, b: int, rank: int) -> bool:
        """Whether a and b form without an earlier merge across their border, so that ``rank`` joins them."""
        ends, begins = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while (i, j) != (len(ends) - 1, len(begins) - 1):
            (x, x_next), (y, y_next) = ends[i], begins[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_next and r <= y_next:
                return False
            if x_next <= y_next:
                i += 1
            else:
                j += 1
        return self.rank.get((a, b)) == rank

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of one word's bytes."""
        n = len(word)
        last = [-1] * (n + 1)
        spelling, compatible, whole = self.spelling, self.compatible, self.whole
        for end, (token, size) in self.automaton.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                before = end - size
                if (before == 0 or (last[before] >= 0 and compatible(last[before], token))) and whole(token):
                    last[end] = token
        out, at = [], n
        while at:
            token = last[at]
            if token < 0:
                raise ValueError("the vocabulary lacks a byte of the text")
            out.append(token)
            at -= len(spelling[token])
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        words = self.words
        if self.special is None or not self.special.search(text):
            return b"".join(map(words.__getitem__, self.word_pattern.findall(text)))
        out, at = [], 0
        for m in self.special.finditer(text):
            out += map(words.__getitem__, self.word_pattern.findall(text[at:m.start()]))
            out.append(np.uint32(self.added[m.group()]).astype("<u4").tobytes())
            at = m.end()
        out += map(words.__getitem__, self.word_pattern.findall(text[at:]))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of encoded ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.spelling.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class _WordTable(dict):
    """word -> encoded ids; forgets everything when full."""

    def __init__(self, pairs: BytePairs):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.pairs.encode_word(word.encode()), dtype="<u4").tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = ids
        return ids


_LOADED: dict[str, BytePairs] = {}


def loaded(text: str) -> BytePairs:
    """The vocabulary, built once a worker."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = BytePairs(text)
    return _LOADED[key]


def _encode_batches(vocabulary, describe, carried: list[str]):
    """describe(texts, ids, decoded) gives the output's own columns."""
    def run(batches):
        pairs = loaded(vocabulary.value)
        for batch in batches:
            for a, b in text_slices(batch["text"]):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part["text"].to_pylist()]
                ids = [pairs.encode(t) for t in texts]
                yield pa.record_batch({"doc_id": part["doc_id"], "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                                       **describe(texts, ids, [pairs.decode(x) for x in ids]), **{c: part[c] for c in carried}})
    return run


def _digests(texts, ids, decoded):
    return {"ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
            "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded], pa.string())}


def _full(texts, ids, decoded):
    return {"ids": pa.array(ids, pa.binary()), "decoded": pa.array(decoded, pa.string())}


def _checked(texts, ids, decoded):
    return {"ids": pa.array(ids, pa.binary()), "round_trip": pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_())}


def _run(docs: DataFrame, vocabulary_path: str, describe, columns: str, carry: tuple[str, ...] = ()) -> DataFrame:
    with open(vocabulary_path, encoding="utf-8") as f:
        text = f.read()
    BytePairs(text)     # a vocabulary of another kind is refused here, not in a task
    cast = docs.sparkSession.sparkContext.broadcast(text)
    d = pick(docs, doc_id="long", text="string", **{c: "string" for c in carry})
    return d.mapInArrow(_encode_batches(cast, describe, list(carry)),
                        f"doc_id long, n_tokens long, {columns}" + "".join(f", {c} string" for c in carry))


def encode(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit), decoded (text of the ids)."""
    return _run(docs, vocabulary_path, _full, "ids binary, decoded string")


def encode_rows(docs: DataFrame, vocabulary_path: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip (whether the decoded text is the text) and the string columns of ``carry``."""
    return _run(docs, vocabulary_path, _checked, "ids binary, round_trip boolean", carry)


def encode_digests(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode`` with its two long columns hashed where they arise."""
    return _run(docs, vocabulary_path, _digests, "ids_sha256 string, decoded_sha256 string")
