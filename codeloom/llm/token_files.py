"""Token-id output as flat binary files (operator 12).

A folder holds, for each part,

* ``NAME.ids``: the token ids of its documents one after another, little-endian unsigned
  16-bit where the vocabulary has at most 65,536 ids, else 32-bit;
* ``NAME.offsets``: n + 1 little-endian 64-bit numbers, where each of the n documents begins in
  the ids file and where the last ends;
* ``NAME.docs``: the n document ids, 64-bit; null ids are written as 0 and are the last ones;

and ``index.json``: the item type, the end id and the parts in document order with their number
of documents, null ids and token ids.  A part's base, the number of ids before it in the corpus,
is the prefix sum of the earlier parts' numbers.  Readers memory-map the files.

Texts are dealt into parts by ranges of the document id, sorted there, encoded and written by
one task a part.  The driver sees one row a part.  Files are named by the task's attempt, so a
lost executor's or a doubled task's files are never mixed up; what no result names is deleted.

Encoding is the ``tokenizers`` library's.  Where its vocabulary drops white space before merging,
no merge, special token or normalisation step reaches over ASCII white space, so distinct runs of other
characters are encoded once a worker and kept in a table of bounded size.  In texts of plain Latin
characters the same holds for the words of the vocabulary's own pattern, which only the library's merges
are applied to.  Other vocabularies get whole texts.

Cases: null is the empty text (only the end id); documents are ordered by id, null ids last,
rows of one id by a hash of the text, rows equal in both as they are scanned; one id or null may
hold any share of the rows (the text's hash and the row's place are part of the ranges); a very
long text stays in one part, which is then longer; other columns are ignored; an empty table
gives an index without parts.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .bpe import byte_alphabet
from .common import pick, text_slices
from .flatfiles import Flat, create, delete_others, read_text, write_text

END_ID = 2
PART_BYTES = 64 << 20       # bytes of text a part, in expectation
CACHED = 600_000
CACHED_LENGTH = 64
READ_IDS = 4 << 20          # ids converted at a time when reading
_WRITTEN = "part int, name string, docs long, nulls long, ids long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def plain_tokenizer(spec: str):
    """A ``tokenizers`` tokenizer from its JSON text that neither truncates nor pads."""
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


# Fixed value: the word pattern of lower-casing vocabularies with word ends.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def drops_spaces(spec: str) -> bool:
    """Whether white space ends every token and is itself in none: the runs between can be encoded apart.

    True for the word pattern above after normalisers that work within such runs.
    """
    s = json.loads(spec)
    kinds = lambda x, parts: [y for y in (x.get(parts) or [x])] if x else []
    normal = all(n["type"] in ("NFC", "Lowercase", "Replace") and (n["type"] != "Replace" or (n["pattern"], n["content"]) == ({"Regex": r"\s+"}, " "))
                 for n in kinds(s.get("normalizer"), "normalizers"))
    pre = kinds(s.get("pre_tokenizer"), "pretokenizers")
    first = pre[0] if pre else {}
    split = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and first["pattern"].get("Regex") == _WORDS
    rest = all(p["type"] == "ByteLevel" and not p["use_regex"] and not p["add_prefix_space"] for p in pre[1:])
    added = all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not any(c.isspace() for c in t["content"]) for t in s.get("added_tokens", []))
    return bool(normal and split and rest and added and s["model"]["type"] == "BPE" and not s["model"].get("dropout"))


# Plain texts: ASCII and Latin letters and signs, each lower-cased to one character, none changed by NFC,
# no control characters but ASCII white space.
_PLAIN = re.compile("[\t-\r -~\u00a1-\u00ac\u00ae-\u012f\u0131-\u017f]*")
# The word pattern above on lower-cased plain texts; the letters and digits of that range are written out.
_PLAIN_WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
                          "|[^\\sa-z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00df-\u00f6\u00f8-\u00ff\u0100-\u017f]+")


class _Table(dict):
    """key -> what ``make`` gives for it; short keys are kept, all are forgotten when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        ids = self.make(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED:
                self.clear()
            self[key] = ids
        return ids


class Encoder:
    """Texts to ids (bytes of little-endian items), word by word or run by run where that is the same."""

    def __init__(self, spec: str, dtype: str):
        self.tokenizer, self.dtype = plain_tokenizer(spec), dtype
        s = json.loads(spec)
        normal = s.get("normalizer") or {}
        self.by_runs = drops_spaces(spec)
        self.lowers = any(n.get("type") == "Lowercase" for n in normal.get("normalizers") or [normal])
        # Special tokens are looked for before lower-casing; texts that might hold one go to the library whole.
        self.special = re.compile("|".join(re.escape(t["content"]) for t in s.get("added_tokens", [])) or r"(?!)", re.IGNORECASE)
        self.model, self.as_char = self.tokenizer.model, {b: c for c, b in byte_alphabet().items()}
        self.words, self.runs = _Table(self._word), _Table(lambda run: self._ids(run.decode()))

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """A word of the pattern: only its bytes' characters and the merges are left to do."""
        return np.array([t.id for t in self.model.tokenize("".join([self.as_char[b] for b in word.encode()]))], dtype=self.dtype).tobytes()

    def encode(self, text: bytes) -> bytes:
        if not self.by_runs:
            return self._ids(text.decode())
        said = text.decode()
        if self.lowers and _PLAIN.fullmatch(said) and not self.special.search(said):
            return b"".join(map(self.words.__getitem__, _PLAIN_WORDS.findall(said.lower())))
        # bytes.split cuts at ASCII white space alone.
        return b"".join(map(self.runs.__getitem__, text.split()))


_ENCODERS: dict[tuple[int, str], Encoder] = {}


def _encoder(spec: str, dtype: str) -> Encoder:
    key = (zlib.crc32(spec.encode()), dtype)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, dtype)
    return _ENCODERS[key]


def item_type(spec: str, end_id: int) -> str:
    """Unsigned 16-bit if every id fits, else 32-bit."""
    return "<u2" if max(plain_tokenizer(spec).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def _writer(spec, folder: str, dtype: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext
        encoder, end = _encoder(spec.value, dtype), np.array([end_id], dtype=dtype).tobytes()
        name, width = f"part-{uuid.uuid4().hex}", np.dtype(dtype).itemsize
        sizes, docs, nulls = [], [], 0
        with create(f"{folder}/{name}.ids") as out:
            for batch in batches:
                ids = batch["doc_id"]
                nulls += ids.null_count
                docs.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                for a, b in text_slices(batch["text"]):
                    rows = [encoder.encode(t or b"") + end for t in batch["text"].slice(a, b - a).cast(pa.binary()).to_pylist()]
                    out.write(b"".join(rows))
                    sizes.append(np.array([len(r) // width for r in rows], dtype="<i8"))
        if not docs or not sum(map(len, docs)):
            return
        offsets = np.concatenate([np.zeros(1, "<i8"), np.cumsum(np.concatenate(sizes), dtype="<i8")])
        for end_of_name, items in (("offsets", offsets), ("docs", np.concatenate(docs))):
            with create(f"{folder}/{name}.{end_of_name}") as out:
                out.write(items.astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist(
            [{"part": TaskContext.get().partitionId(), "name": name, "docs": len(offsets) - 1, "nulls": nulls, "ids": int(offsets[-1])}],
            schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("nulls", pa.int64()), ("ids", pa.int64())]))
    return run


def write_tokens(docs: DataFrame, vocabulary_path: str, folder: str | None = None, end_id: int = END_ID, part_bytes: int = PART_BYTES) -> str:
    """Encode every text, append ``end_id``, and write the files described above; returns the folder.

    Without ``folder`` it is a new one in the shared folder; the caller deletes it when done.
    """
    spark = docs.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = f.read()
    dtype = item_type(spec, end_id)
    folder = folder or f"{ensure_checkpoint_dir(spark)}/llm-token-files-{uuid.uuid4().hex}"
    d = pick(docs, doc_id="long", text="string")
    size = d.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    parts = []
    if size["n"]:
        n = max(-(-int(size["b"]) // part_bytes), min(size["n"], spark.sparkContext.defaultParallelism))
        order = [F.asc("last"), F.asc("doc_id"), F.asc("h"), F.asc("place")]
        rows = d.select("doc_id", "text", F.col("doc_id").isNull().alias("last"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("place"))
        dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
        spec_ = spark.sparkContext.broadcast(spec)     # bounded: the vocabulary file
        parts = sorted(dealt.mapInArrow(_writer(spec_, folder, dtype, end_id), _WRITTEN).collect())
    index = {"dtype": dtype, "end_id": end_id, "parts": [{k: r[k] for k in ("name", "docs", "nulls", "ids")} for r in parts]}
    write_text(spark, f"{folder}/index.json", json.dumps(index))
    delete_others(spark, folder, {"index.json"} | {f"{r['name']}.{e}" for r in parts for e in ("ids", "offsets", "docs")})
    return folder


class TokenFiles:
    """A written folder, for reading on one machine: ``files.document(i)`` is (doc_id, start, ids) of the i-th document."""

    def __init__(self, folder: str, index: dict):
        self.folder, self.index = folder, index
        self.first = [0, *itertools.accumulate(p["docs"] for p in index["parts"])]
        self.base = [0, *itertools.accumulate(p["ids"] for p in index["parts"])]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TokenFiles:
        return cls(folder, json.loads(read_text(spark, f"{folder}/index.json")))

    def part(self, k: int) -> tuple[Flat, Flat, Flat]:
        p, at = self.index["parts"][k], f"{self.folder}/{self.index['parts'][k]['name']}"
        return Flat(f"{at}.ids", self.index["dtype"], p["ids"]), Flat(f"{at}.offsets", "<i8", p["docs"] + 1), Flat(f"{at}.docs", "<i8", p["docs"])

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        k = int(np.searchsorted(self.first, i, side="right")) - 1
        ids, offsets, docs = self.part(k)
        j = i - self.first[k]
        a, b = (int(x) for x in offsets[j:j + 2])
        null = j >= self.index["parts"][k]["docs"] - self.index["parts"][k]["nulls"]
        return None if null else int(docs[j:j + 1][0]), self.base[k] + a, ids[a:b]


def _reader(files: TokenFiles, ids_too: bool):
    def run(batches):
        for batch in batches:
            for k in batch["id"].to_pylist():
                p, base = files.index["parts"][k], files.base[k]
                ids, offsets, docs = files.part(k)
                at = np.asarray(offsets[0:p["docs"] + 1])
                a = 0
                while a < p["docs"]:
                    b = min(p["docs"], max(a + 1, int(np.searchsorted(at, at[a] + READ_IDS, side="right")) - 1))
                    wide = ids[int(at[a]):int(at[b])].astype("<u4")
                    cuts = (at[a:b + 1] - at[a]).tolist()
                    each = [wide[x:y] for x, y in itertools.pairwise(cuts)]
                    yield pa.record_batch({
                        "doc_id": pa.array(np.asarray(docs[a:b]), pa.int64(), mask=np.arange(a, b) >= p["docs"] - p["nulls"]),
                        "start": pa.array(base + at[a:b], pa.int64()), "n_tokens": pa.array(np.diff(at[a:b + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())}
                        | ({"ids": pa.array([x.tobytes() for x in each], pa.binary())} if ids_too else {}))
                    a = b
    return run


def read_tokens(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ``ids`` (little-endian unsigned 32-bit) of every document, read from the files.

    One task a part; start counts the ids of all documents before, ids_crc32 is over the ids as 32-bit integers.
    """
    files = TokenFiles.open(spark, folder)
    n = len(files.index["parts"])
    schema = _READ + (", ids binary" if ids else "")
    if not n:
        return spark.createDataFrame([], schema)
    return spark.range(0, n, 1, n).mapInArrow(_reader(files, ids), schema)
