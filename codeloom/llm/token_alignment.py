"""Alignment of two tokenizers' tokens by lockstep vectorised merging (operator 11).

Tokenizer A is a byte-level BPE of the ``tokenizers`` library, B a ``sentencepiece`` model.
Both spell the text with one space before it, so their tokens end at byte offsets of the same
string.  Offsets where an A token and a B token end are cuts; the tokens between two cuts are a
group, and every A token of a group is linked with every B token of it.

1. *Lockstep.*  One state vector holds an A and a B pointer for each lane.  A step compares
   the ends at all pointers, advances the pointer that ends first (both at a cut), emits the cuts
   with the links of the groups they close, and finished lanes are compacted away.  A lane is a
   document; long documents get more lanes, which begin at cuts found near every LANE-th token,
   so that the number of steps does not follow the longest text.
2. *Blocks.*  A task works through its documents in blocks of bounded text.  A block has
   its documents' figures, its distinct linked id pairs with the number of its documents that
   hold them, and each document's pairs as places in that list, in rows of bounded size: readers,
   writers and sorts hold many rows at once.
3. *Counts.*  The blocks' pair counts are summed over the corpus, and the highest of each A id is
   taken.  Only a block's distinct pairs are shuffled, never tokens or texts.
4. Each block gets its pairs' counts back and sums them for each document; blocks are met with
   their counts one after another, so a task holds one block whatever the number of its blocks.

Encodings: a text is cut where both tokenizers always cut, each distinct piece is encoded once a
worker by the library and kept in a table of bounded size.  Texts of plain Latin characters are cut
into the words of A's pattern, and for B where letters, digits, other signs and spaces meet (the model's
pieces are checked to hold one kind only); other texts before a space between two other characters;
texts with characters for which this is not proven (white space beyond ASCII, control separators), or of
models whose pieces do not allow it, are encoded whole.  Special tokens written in a text are plain text.

Cases: null and empty texts, and texts that A or B do not spell byte for byte, have no tokens: zeros
and an empty digest; repeated rows and repeated ids are documents of their own; null ids
stay; a very long text is worked through in slabs; other columns are ignored; an empty table
gives no rows.  A group of very many tokens costs its distinct ids on either side, multiplied.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import exchanged
from .bpe import byte_alphabet
from .common import discard, pick, staged
from .token_files import plain_tokenizer

BLOCK_BYTES = 4 << 20       # text of a block
BLOCK_DOCS = 50_000         # documents of a block, at most
ROW_PAIRS = 1 << 15         # pairs of a block's row, about; a document's are in one
DOC_PAIRS = 16              # pairs that a document's other figures count as
ROW_GROUP = 8 << 20         # bytes of the blocks' files that are read at once
SLAB_BYTES = 2 << 20        # text aligned at once
LANE = 256                  # A tokens of a lane, about
LOOK = 32                   # tokens looked at for a lane's first cut
WIDE = 4_096                # links of a group that are written out one by one
CACHED_PIECES = 250_000
CACHED_LENGTH = 64

_PIECES_A = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
_PIECES_B = re.compile(r" *[^ ]+(?: +\Z)?| +")     # spaces at the end belong to the last piece
# White space beyond ASCII, zero-width and control characters, and the sign that stands for a space in B's pieces.
_UNPROVEN = re.compile("[" + "".join(chr(c) for c in (0, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200E), 0x2028, 0x2029, 0x202F,
                                                      0x205F, 0x2060, 0x2581, 0x3000, 0xFEFF)) + "]")
# Plain texts: ASCII and Latin letters and signs, no control characters but ASCII white space.  In them the classes
# of characters can be written out: letters, A's other numbers, and the rest.
_PLAIN = re.compile("[\t-\r -~\u00a1-\u00ac\u00ae-\u017f]*")
_LETTERS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
_NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
# Fixed value: A's word pattern (see bpe.WORDS), its classes written out for plain texts.
_WORDS_A = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\\s{_LETTERS}{_NUMBERS}]+|\\s+(?!\\S)|\\s+")
# Letters, digits and other characters with the spaces before them; spaces at the end belong to the last.
_WORDS_B = re.compile(f" *(?:[{_LETTERS}]+|[0-9]+|[^ {_LETTERS}0-9]+)(?: +\\Z)?| +")
_ONE_CLASS = re.compile(f"\u2581*(?:[{_LETTERS}]*|[0-9]*|[^\u2581{_LETTERS}0-9]*)")
_SLAB_END = re.compile(r"(?<=[^ \t-\r]) (?=[^ \t-\r])")


class _Pieces(dict):
    """piece -> its ids as little-endian unsigned 32-bit, None if they do not spell it; forgotten when full."""

    def __init__(self, encode, spelling: list[bytes]):
        super().__init__()
        self.encode, self.spelling = encode, spelling

    def ids(self, piece: str) -> bytes | None:
        ids = self.encode(piece)
        if b"".join([self.spelling[i] for i in ids]) != piece.encode():
            return None
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, piece: str) -> bytes | None:
        ids = self.ids(piece)
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Tokenizers:
    """A and B with their tokens' bytes."""

    def __init__(self, spec_a: str, model_b: bytes):
        import sentencepiece
        a = plain_tokenizer(spec_a)
        a.encode_special_tokens = True
        spec = json.loads(spec_a)
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            raise ValueError("tokenizer A must be a byte-level BPE without normaliser and prefix space")
        as_byte, size = byte_alphabet(), a.get_vocab_size(with_added_tokens=True)
        spell_a = [b""] * size
        for token, i in spec["model"]["vocab"].items():
            spell_a[i] = bytes(as_byte[c] for c in token)
        b = sentencepiece.SentencePieceProcessor(model_proto=model_b)
        n = b.get_piece_size()
        names = b.id_to_piece(list(range(n)))
        # Fixed format: byte pieces are written <0xHH>, a space is U+2581.
        spell_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.size_a, self.size_b = size, n
        self.bytes_a, self.bytes_b = (np.array([len(x) for x in s], dtype=np.int64) for s in (spell_a, spell_b))
        # B's own space before the text is the one before every piece here.
        as_char, merges = {c: x for x, c in as_byte.items()}, a.model
        self.a = _Pieces(lambda t: a.encode(t, add_special_tokens=False).ids, spell_a)
        # A word of the pattern: only its bytes' characters and the merges are left to do.
        self.words_a = _Pieces(lambda t: [x.id for x in merges.tokenize("".join([as_char[y] for y in t.encode()]))], spell_a)
        # Words without a space before them are encoded behind a character of another class, whose tokens are dropped.
        drop = {c: len(b.encode(c)) for c in ".a"}

        def encode_b(t: str) -> list[int]:
            if t[0] == " ":
                return b.encode(t[1:], num_threads=1)
            other = "." if re.match(f"[{_LETTERS}0-9]", t) else "a"
            return b.encode(other + t, num_threads=1)[drop[other]:]

        self.b = _Pieces(encode_b, spell_b)
        # A merge over the border before a space needs a piece with a space behind another character.
        self.cuts_b = not any(re.search("[^▁]▁", p) for p in names)
        self.cuts_a = bool(pre.get("use_regex", True))
# Pieces with other characters occur in no plain text.
        self.classes_b = self.cuts_b and all(_ONE_CLASS.fullmatch(p) for i, p in enumerate(names)
                                             if _PLAIN.fullmatch(p.replace("\u2581", " ")) and not b.is_byte(i) and not b.is_control(i) and not b.is_unknown(i))
        # Written forms: id with the sign that follows it, for digests.
        self.written = [f"{i}{sign}" for i in range(size) for sign in ",|"] + [f"{i}{sign}" for i in range(n) for sign in ",;"]

    def encode(self, full: str, first: bool, whole: bool) -> tuple[bytes, bytes] | None:
        """Ids of a slab (it begins with a space; ``whole`` if it is the whole text), None if it is not spelled."""
        table_a = self.a
        if self.cuts_a and self.classes_b and _PLAIN.fullmatch(full):
            table_a, pieces_a, pieces_b = self.words_a, _WORDS_A.findall(full), _WORDS_B.findall(full)
        elif self.cuts_a and self.cuts_b and not _UNPROVEN.search(full):
            pieces_a, pieces_b = _PIECES_A.findall(full), _PIECES_B.findall(full)
        elif whole:
            pieces_a = pieces_b = [full]
        else:
            raise ValueError("such a text is one slab")
        try:
            return b"".join(map(table_a.__getitem__, pieces_a)), b"".join(map(self.b.__getitem__, pieces_b))
        except TypeError:                       # a None: a piece that its ids do not spell
            return None

    def slabs(self, text: str) -> list[str]:
        """The text, a space before it, in slabs that are encoded apart."""
        full = " " + text
        if len(full) <= SLAB_BYTES or not (self.cuts_a and self.cuts_b) or _UNPROVEN.search(full):
            return [full]
        out, at = [], 0
        while len(full) - at > SLAB_BYTES:
            m = _SLAB_END.search(full, at + SLAB_BYTES // 2)
            if m is None:
                break
            out.append(full[at:m.start()])
            at = m.start()
        return [*out, full[at:]]


_LOADED: dict[bytes, Tokenizers] = {}


def loaded(spec_a: str, model_b: bytes) -> Tokenizers:
    key = hashlib.sha256(spec_a.encode() + model_b).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Tokenizers(spec_a, model_b)
    return _LOADED[key]


def _lanes(ends_a, ends_b, first_a, first_b):
    """Starts of all lanes (A place, B place): every document's, and cuts near every LANE-th token of long ones."""
    size = np.diff(first_a)
    more = (size - LOOK - 2) // LANE
    doc = np.repeat(np.arange(len(size)), np.maximum(more, 0))
    if not len(doc):
        return first_a[:-1], first_b[:-1]
    k = np.arange(len(doc)) - np.repeat(np.cumsum(np.maximum(more, 0)) - np.maximum(more, 0), np.maximum(more, 0)) + 1
    look = (first_a[doc] + k * LANE)[:, None] + np.arange(LOOK)[None, :]
    where = np.searchsorted(ends_b, ends_a[look])
    cut = ends_b[np.minimum(where, len(ends_b) - 1)] == ends_a[look]
    have, at = cut.any(axis=1), cut.argmax(axis=1)
    rows = np.arange(len(doc))
    a = np.concatenate([first_a[:-1], (look[rows, at] + 1)[have]])
    b = np.concatenate([first_b[:-1], (where[rows, at] + 1)[have]])
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def lockstep(ends_a, ends_b, first_a, first_b):
    """Groups (first A, last A, first B, last B) in order, and links (A place, B place) of all groups up to WIDE links.

    ends_*: each token's end in the joined bytes of all documents; first_*: where each document's tokens begin, and
    where the last one's end.  Both sides' documents end at the same offsets.
    """
    start_a, start_b = _lanes(ends_a, ends_b, first_a, first_b)
    stop = np.append(start_a[1:], first_a[-1])
    some = start_a < stop
    i, j, stop = start_a[some], start_b[some], stop[some]
    group_a, group_b = i.copy(), j.copy()
    cuts, link_a, link_b = [], [], []
    while len(i):
        x, y = ends_a[i], ends_b[j]
        met = x == y
        if met.any():
            a, b, la, lb = group_a[met], group_b[met], i[met], j[met]
            cuts.append((a, la, b, lb))
            wide_a, wide_b = la - a + 1, lb - b + 1
            links = wide_a * wide_b
            one = links == 1
            link_a.append(a[one])
            link_b.append(b[one])
            if not one.all():
                some = ~one & (links <= WIDE)
                n, nb = links[some], wide_b[some]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                link_a.append(np.repeat(a[some], n) + place // np.repeat(nb, n))
                link_b.append(np.repeat(b[some], n) + place % np.repeat(nb, n))
        i, j = i + (x <= y), j + (y <= x)
        group_a, group_b = np.where(met, i, group_a), np.where(met, j, group_b)
        alive = i < stop
        if not alive.all():                                     # compact
            i, j, stop, group_a, group_b = i[alive], j[alive], stop[alive], group_a[alive], group_b[alive]
    none = np.zeros(0, np.int64)
    groups = [np.concatenate(c) if c else none for c in zip(*cuts, strict=True)] or [none] * 4
    order = np.argsort(groups[0])
    return tuple(g[order] for g in groups), (np.concatenate(link_a) if link_a else none, np.concatenate(link_b) if link_b else none)


def _wide_links(groups, ids_a, ids_b, doc_of_a, code):
    """(code, times) of the groups with more than WIDE links: distinct ids multiplied, not tokens."""
    a, la, b, lb = groups
    codes, times = [], []
    for g in np.flatnonzero((la - a + 1) * (lb - b + 1) > WIDE):
        x, times_x = np.unique(ids_a[a[g]:la[g] + 1], return_counts=True)
        y, times_y = np.unique(ids_b[b[g]:lb[g] + 1], return_counts=True)
        codes.append(code(doc_of_a[a[g]], x[:, None], y[None, :]).ravel())
        times.append((times_x[:, None] * times_y[None, :]).ravel())
    return codes, times


def _summed(code, times):
    """Equal codes' times added up, in the codes' order."""
    order = np.argsort(code)
    code, times = code[order], times[order]
    new = np.ones(len(code), bool)
    new[1:] = code[1:] != code[:-1]
    at = np.flatnonzero(new)
    return code[at], np.add.reduceat(times, at) if len(at) else times


class _Block:
    """The documents of one block, aligned slab by slab."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.doc_id, self.digest = [], []
        self.n_a, self.n_b, self.n_groups, self.n_links = [], [], [], []
        self.links: list[tuple[np.ndarray, np.ndarray]] = []        # (code of document and pair, times)
        self.bytes = 0
        self._slab: list[tuple[int, bool, bytes, bytes]] = []   # (document, whether its last slab, A ids, B ids)
        self._slab_bytes = 0

    def add(self, doc_id, text: str | None) -> None:
        doc = len(self.doc_id)
        self.doc_id.append(doc_id)
        self.digest.append(None)
        for column in (self.n_a, self.n_b, self.n_groups, self.n_links):
            column.append(0)
        if not text:
            return
        slabs = self.t.slabs(text)
        encoded = []
        for k, slab in enumerate(slabs):
            ids = self.t.encode(slab, k == 0, len(slabs) == 1)
            if ids is None:
                return
            encoded.append(ids)
        self.digest[doc] = hashlib.sha256()
        for k, (slab, ids) in enumerate(zip(slabs, encoded, strict=True)):
            self._slab.append((doc, k == len(slabs) - 1, *ids))
            self._slab_bytes += len(slab)
            if self._slab_bytes >= SLAB_BYTES:
                self._align()
        self.bytes += len(text)

    def _align(self) -> None:
        if not self._slab:
            return
        t, parts = self.t, self._slab
        self._slab, self._slab_bytes = [], 0
        doc = np.array([p[0] for p in parts])
        ids_a, ids_b = (np.frombuffer(b"".join([p[k] for p in parts]), "<u4").astype(np.int64) for k in (2, 3))
        first_a, first_b = (np.concatenate([[0], np.cumsum([len(p[k]) // 4 for p in parts])]) for k in (2, 3))
        ends_a, ends_b = np.cumsum(t.bytes_a[ids_a]), np.cumsum(t.bytes_b[ids_b])
        groups, (link_a, link_b) = lockstep(ends_a, ends_b, first_a, first_b)
        a, la, b, lb = groups
        wide_a, wide_b = la - a + 1, lb - b + 1
        part = np.searchsorted(first_a, a, side="right") - 1           # of each group
        per_group = np.bincount(part, minlength=len(parts))
        links = np.bincount(part, weights=wide_a * wide_b, minlength=len(parts)).astype(np.int64)
        doc_of_a = np.repeat(doc, np.diff(first_a))
        # A document's codes fill one stretch of numbers, below 2**63 for BLOCK_DOCS documents.
        code = lambda d, x, y: (d * t.size_a + x) * t.size_b + y
        single = np.unique(code(doc_of_a[link_a], ids_a[link_a], ids_b[link_b]), return_counts=True)
        codes, times = _wide_links(groups, ids_a, ids_b, doc_of_a, code)
        self.links.append(_summed(np.concatenate([single[0], *codes]), np.concatenate([single[1], *times])) if codes else single)
        # Written order: the groups one after another, A ids then B ids.
        at = np.cumsum(wide_a + wide_b) - (wide_a + wide_b)
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
        last_a[la], last_b[lb] = 1, 1
        codes[np.arange(len(ids_a)) + np.repeat(at - a, wide_a)] = ids_a * 2 + last_a
        codes[np.arange(len(ids_b)) + np.repeat(at + wide_a - b, wide_b)] = (ids_b + t.size_a) * 2 + last_b
        written, bounds = t.written, (first_a + first_b).tolist()
        for k, (d, ends, _, _) in enumerate(parts):
            said = "".join(map(written.__getitem__, codes[bounds[k]:bounds[k + 1]].tolist()))
            self.digest[d].update((said[:-1] if ends else said).encode())
            self.n_a[d] += int(first_a[k + 1] - first_a[k])
            self.n_b[d] += int(first_b[k + 1] - first_b[k])
            self.n_groups[d] += int(per_group[k])
            self.n_links[d] += int(links[k])

    def row(self) -> pa.RecordBatch:
        """The block as one row."""
        (row,) = self.rows(0, 1 << 62)
        return row

    def rows(self, number: int, size: int = 0) -> Iterator[pa.RecordBatch]:
        """The block under this number, ``size`` (ROW_PAIRS) pairs a row: some documents with their pairs, and the list's pairs from place ``first`` on."""
        self._align()
        size = size or ROW_PAIRS
        none = np.zeros(0, np.int64)
        code, times = _summed(*(np.concatenate(c) for c in zip(*self.links, strict=True))) if self.links else (none, none)
        doc, pair = np.divmod(code, self.t.size_a * self.t.size_b)
        keys, place, holders = np.unique(pair, return_inverse=True, return_counts=True)
        keys, place = keys // self.t.size_b << 32 | keys % self.t.size_b, place.reshape(-1)
        one = lambda values, kind: pa.array([values], pa.list_(kind))
        held = np.bincount(doc, minlength=len(self.doc_id))
        ends, upto = np.concatenate([[0], np.cumsum(held)]), np.cumsum(held + DOC_PAIRS)
        cuts = np.append(np.flatnonzero(np.diff((upto - held - DOC_PAIRS) // size, prepend=-1)), len(held))
        for k in range(max(len(cuts) - 1, -(-len(keys) // size))):
            lo, hi = cuts[min(k, len(cuts) - 1)], cuts[min(k + 1, len(cuts) - 1)]
            own, listed = slice(ends[lo], ends[hi]), slice(k * size, (k + 1) * size)
            step = np.diff(place[own], prepend=0)               # small but where a document begins
            yield pa.record_batch({
                "block": pa.array([number], pa.int64()), "first": pa.array([k * size], pa.int64()),
                "doc_id": one(self.doc_id[lo:hi], pa.int64()), "n_a": one(self.n_a[lo:hi], pa.int64()), "n_b": one(self.n_b[lo:hi], pa.int64()),
                "n_groups": one(self.n_groups[lo:hi], pa.int64()), "n_links": one(self.n_links[lo:hi], pa.int64()),
                "groups_sha256": one(["" if d is None else d.hexdigest() for d in self.digest[lo:hi]], pa.string()),
                "held": one(held[lo:hi], pa.int64()), "places": pa.array([_planes(step)], pa.binary()), "times": pa.array([_planes(times[own])], pa.binary()),
                "keys": one(keys[listed], pa.int64()), "holders": one(holders[listed], pa.int64())})


def _planes(x: np.ndarray) -> bytes:
    """Integers as planes of bytes, as many as the largest needs: small ones are small in memory too."""
    most = int(max(x.max(), -1 - x.min())) if len(x) else 0
    width = most.bit_length() // 8 + 1
    return bytes([width]) + np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    width = data[0]
    out = np.zeros(((len(data) - 1) // width, 8), np.uint8)
    out[:, 8 - width:] = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1).T
    return out.view("<i8").ravel() >> (64 - 8 * width)          # with their signs


_DOC = "doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>"
_BLOCK = f"block long, first long, {_DOC}, held array<long>, places binary, times binary, keys array<long>, holders array<long>"
_ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(spec_a, model_b):
    def run(batches):
        t = loaded(spec_a.value, model_b.value)
        # Numbers of their own for every task: the partition's, then the block's in it.
        block, number = _Block(t), TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                block.add(doc_id, text.as_py())
                if block.bytes >= BLOCK_BYTES or len(block.doc_id) >= BLOCK_DOCS:
                    yield from block.rows(number)
                    block, number = _Block(t), number + 1
        if block.doc_id:
            yield from block.rows(number)
    return run


def _scored(docs: pa.Table, found: pa.Table) -> pa.Table:
    """A block's documents and its pairs' corpus counts to one row a document."""
    order = np.empty(found.num_rows, np.int64)
    order[found["pos"].to_numpy()] = np.arange(found.num_rows)
    count, best = found["n"].to_numpy()[order], found["best"].to_numpy()[order]
    parts = []
    for k in range(docs.num_rows):
        row = docs.slice(k, 1)
        flat = lambda name: row[name].combine_chunks().flatten()  # noqa: E731,B023
        held = flat("held").to_numpy()
        place, times = np.cumsum(_from_planes(row["places"][0].as_py())), _from_planes(row["times"][0].as_py())
        parts.append(pa.table({
            **{c: flat(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")},
            "n_best": pa.array(_added(times * best[place], held)), "count_sum": pa.array(_added(times * count[place], held)), "groups_sha256": flat("groups_sha256")}))
    return pa.concat_tables(parts)


def _added(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of these sizes."""
    total, ends = np.concatenate([[0], np.cumsum(x)]), np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def _aligned_blocks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The blocks' rows, staged."""
    with open(path_a, encoding="utf-8") as f:
        spec_a = f.read()
    with open(path_b, "rb") as f:
        model_b = f.read()
    Tokenizers(spec_a, model_b)     # vocabularies of another kind are refused here, not in a task
    sc = docs.sparkSession.sparkContext
    cast_a, cast_b = sc.broadcast(spec_a), sc.broadcast(model_b)    # bounded: the vocabulary files
    rows = pick(docs, doc_id="long", text="string").mapInArrow(_blocks(cast_a, cast_b), _BLOCK)
    return staged(rows, "alignment", row_group=ROW_GROUP)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """key (A id in the upper, B id in the lower half), n: the documents that hold the pair linked, best: whether none of its A id has more."""
    pairs = (blocks.select(F.explode(F.arrays_zip("keys", "holders")).alias("p")).groupBy(F.col("p.keys").alias("key"))
             .agg(F.sum("p.holders").alias("n")))
    # At most one row a B id and A id; an A id's rows fit any task.
    highest = pairs.groupBy(F.shiftright("key", 32).alias("a")).agg(F.max("n").alias("most"))
    return (pairs.withColumn("a", F.shiftright("key", 32)).join(highest, "a")
            .select("key", "n", (F.col("n") == F.col("most")).alias("best")))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """id_a, id_b, n, best: every linked id pair of the corpus with the number of documents that hold it."""
    counts = _pair_counts(_aligned_blocks(docs, path_a, path_b))
    return counts.select(F.shiftright("key", 32).alias("id_a"), F.col("key").bitwiseAND(0xFFFFFFFF).alias("id_b"), "n", "best")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row; see the module's notes."""
    blocks = _aligned_blocks(docs, path_a, path_b)
    counts = staged(_pair_counts(blocks), "pair-counts")
    listed = blocks.select("block", "first", F.posexplode("keys").alias("at", "key")).select("block", "key", (F.col("first") + F.col("at")).cast("int").alias("pos"))
    # The counts grow with the corpus: never sent whole, whatever their compressed size.
    found = listed.join(exchanged(counts), "key").select(F.col("block").alias("of"), "pos", "n", "best")
    own = blocks.where(F.size("doc_id") > 0).drop("first", "keys", "holders")
    out = staged(own.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_scored, _ALIGNED), "aligned")
    discard(blocks, counts)
    return out


# --- one text at a time ---

def aligned_text(text: str, path_a: str, path_b: str) -> list[tuple[list[int], list[int]]]:
    """The groups (A ids, B ids) of one text, for use without Spark."""
    t = _of_files(path_a, path_b)
    ids = t.encode(" " + text, True, True) if text else None
    if ids is None:
        return []
    a, b = (np.frombuffer(x, "<u4").astype(np.int64) for x in ids)
    groups, _ = lockstep(np.cumsum(t.bytes_a[a]), np.cumsum(t.bytes_b[b]), np.array([0, len(a)]), np.array([0, len(b)]))
    return [(a[x:y + 1].tolist(), b[z:w + 1].tolist()) for x, y, z, w in zip(*groups, strict=True)]


@functools.lru_cache(maxsize=1)
def _of_files(path_a: str, path_b: str) -> Tokenizers:
    with open(path_a, encoding="utf-8") as f, open(path_b, "rb") as g:
        return Tokenizers(f.read(), g.read())
