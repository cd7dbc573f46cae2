"""Token ids in binary files: each document compressed by itself with a dictionary that all share."""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_bucket, partitions, workspace, written

#: Documents whose ids train the dictionary (first by a hash of the id), most code points of each (a window
#: at a hashed place of a longer text), and the dictionary's bytes: some hundred times fewer than the sample's.
DICTIONARY_DOCUMENTS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 20_000, 32 << 10
#: Bytes of frames that a reader asks of the store at once.
_READ = 4 << 20
#: Words whose ids a worker remembers.
_REMEMBERED = 800_000

#: File format: MAGIC, version and bytes to an id (4 bytes each, little-endian, as all numbers), the
#: dictionary's SHA-256; each document's frame; then, as 8-byte integers, ids (null: least integer),
#: frames' ends, documents' token counts; last, the index's place, number of documents, tokens, MAGIC.
MAGIC = b"FLTOKEN1"
_NULL = np.iinfo(np.int64).min

#: Split by Python at these, but not white space to the tokenizer.
_ODD = re.compile("[\x1c-\x1f]")


@cache
def _byte_chars() -> dict[int, str]:
    """The printable character that byte-level tokenizers put for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


def _lower(word: str) -> str:
    """Lower case of each code point by itself."""
    return "".join(map(str.lower, word))


class WordIds(dict):
    """Ids of words between white space, as stored, by the tokenizers library; remembered, as most come again.

    Words of letters only go straight to the library's model, which gets what its normalizer and
    pre-tokenizer would give; punctuation behind them is encoded apart, as the pre-tokenizer would cut it,
    unless the lower-cased word ends in a mark that would go with it; all others go through the whole
    tokenizer. The strings of special tokens in a text are those tokens, as the library has it by default.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.map = _byte_chars()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"

    def stored(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def whole(self, text: str) -> bytes:
        return self.stored(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= _REMEMBERED:
            self.clear()
        core = word.rstrip(string.punctuation)
        if core and len(core) < len(word) and core.isalpha() and (core.isascii() or _lower(unicodedata.normalize("NFC", core)).isalpha()):
            found = self[core] + self[word[len(core) :]]
        elif word.isalpha() and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            low = word.lower() if word.isascii() else _lower(word)
            if not low.isalpha():
                found = self.whole(word)
            elif low != word and (low.isascii() or unicodedata.is_normalized("NFC", low)):
                found = self[low]
            else:
                found = self.stored([t.id for t in self.model.tokenize("".join(map(self.map.__getitem__, low.encode())))])
        else:
            found = self.whole(word)
        self[word] = found
        return found

    def ids(self, text: str) -> np.ndarray:
        """Whole texts, whatever their length."""
        if _ODD.search(text):
            return np.frombuffer(self.whole(text), self.dtype)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), self.dtype)


@cache
def _words(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def _ids(path: str, text: str | None, end: int) -> np.ndarray:
    return np.append(_words(path).ids(text or ""), np.array(end, _words(path).dtype))


def _frames(batches: Iterator[pa.RecordBatch], path: str, end: int, width: int, dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """(bucket, id, text, tie) to (bucket, id, tokens, frame, tie)."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=3, dict_data=shared) if shared else zstandard.ZstdCompressor(level=3)
    for b in batches:
        tokens, frames = [], []
        for t in b.column(2):
            ids = _ids(path, t.as_py(), end)
            tokens.append(len(ids))
            frames.append(press.compress(ids.astype(f"<u{width}").tobytes()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(tokens, pa.int64()), pa.array(frames, pa.binary()), b.column(3)], ["bucket", "id", "tokens", "frame", "tie"])


def _save(batches: Iterator[pa.RecordBatch], folder: str, width: int, dictionary_hash: bytes) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket and id to one file a bucket; gives out a row for each file that is complete.

    A retried task writes files of new names; only those that a finished task names are ever read.
    """
    store, root = pafs.FileSystem.from_uri(folder)
    bucket, out, at, ids, ends, tokens, name = None, None, 0, [], [], [], ""

    def finish() -> pa.RecordBatch:
        index = np.concatenate([np.array(x, "<i8") for x in (ids, ends, tokens)]).tobytes()
        out.write(index + np.array([at, len(ids), sum(tokens)], "<i8").tobytes() + MAGIC)
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in (bucket, f"{folder}/{name}", len(ids), sum(tokens))], ["bucket", "path", "documents", "tokens"])

    for b in batches:
        for k, i, n, frame in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
            if k != bucket:
                if out:
                    yield finish()
                bucket, ids, ends, tokens, name = k, [], [], [], f"{k:08d}-{uuid.uuid4().hex}.tok"
                out = store.open_output_stream(f"{root}/{name}")
                out.write(head := MAGIC + np.array([1, width], "<u4").tobytes() + dictionary_hash)
                at = len(head)
            out.write(frame)
            at += len(frame)
            ids.append(_NULL if i is None else i)
            ends.append(at)
            tokens.append(n)
    if out:
        yield finish()


class TokenFile:
    """Reads a token file; one document's ids cost the index and that document's bytes only."""

    def __init__(self, path: str, dictionary: bytes) -> None:
        store, place = pafs.FileSystem.from_uri(path)
        self.file = store.open_input_file(place)
        size = self.file.size()
        tail = self._at(size - 32, 32)
        head = self._at(0, 48)
        if tail[24:] != MAGIC or head[:8] != MAGIC or head[16:] != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} isn't a token file of this dictionary")
        self.width = int(np.frombuffer(head, "<u4", 2, 8)[1])
        at, n, self.tokens = np.frombuffer(tail, "<i8", 3).tolist()
        self.ids, self.ends, self.counts = np.frombuffer(self._at(at, 24 * n), "<i8").reshape(3, n)
        self.starts = np.r_[48, self.ends[:-1]]
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.press = zstandard.ZstdDecompressor(dict_data=shared) if shared else zstandard.ZstdDecompressor()

    def _at(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def __len__(self) -> int:
        return len(self.ids)

    def document(self, i: int) -> np.ndarray:
        """Token ids of the i-th document of the file."""
        return self.documents(i, i + 1)[0]

    def documents(self, lo: int, hi: int) -> list[np.ndarray]:
        """Token ids of the documents from the lo-th to before the hi-th, by one range read."""
        at = int(self.starts[lo])
        raw = memoryview(self._at(at, int(self.ends[hi - 1]) - at))
        cut = [(int(a) - at, int(b) - at) for a, b in zip(self.starts[lo:hi], self.ends[lo:hi], strict=True)]
        return [np.frombuffer(self.press.decompress(raw[a:b]), f"<u{self.width}").astype("<u4") for a, b in cut]

    def find(self, doc_id: int) -> np.ndarray:
        """Token ids of the document with this id."""
        i = int(np.searchsorted(self.ids, doc_id))
        if i == len(self) or self.ids[i] != doc_id:
            raise KeyError(doc_id)
        return self.document(i)


def _read(batches: Iterator[pa.RecordBatch], dictionary: bytes) -> Iterator[pa.RecordBatch]:
    """(path, base) to (id, start, n_tokens, ids)."""
    for b in batches:
        for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            f = TokenFile(path, dictionary)
            start = base + np.r_[0, np.cumsum(f.counts)[:-1]].astype(np.int64)
            lo = 0
            while lo < len(f):  # some frames at a time, by their bytes
                hi = max(lo + 1, min(lo + 500, int(np.searchsorted(f.ends, f.starts[lo] + _READ, "right"))))
                ids = [None if x == _NULL else x for x in f.ids[lo:hi].tolist()]
                raw = [x.tobytes() for x in f.documents(lo, hi)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(start[lo:hi]), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary())], ["id", "start", "n_tokens", "ids"])
                lo = hi


def _dictionary(docs: DataFrame, path: str, end: int, width: int) -> bytes:
    """Trained on a bounded sample, at most SAMPLE_CHARS of each text; empty where there is too little to train on.

    Only compression hangs on the sample: every document is encoded and stored whole."""
    first = docs.select("id").where("id is not null").orderBy(F.xxhash64("id"), "id").limit(DICTIONARY_DOCUMENTS).distinct()
    room = F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(0)) + 1
    piece = F.substring("text", (F.pmod(F.xxhash64(F.lit(5), "id"), room) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    some = [r[0] for r in docs.join(F.broadcast(first), "id").select(piece.alias("t"), "id").orderBy("id", "t").limit(DICTIONARY_DOCUMENTS).select("t").collect()]
    samples = [_ids(path, t, end).astype(f"<u{width}").tobytes() for t in some]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def save(docs: DataFrame, path: str, end: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[DataFrame, bytes]:
    """Encodes every whole text and writes token files: (manifest, dictionary).

    ``path`` names a tokenizer's file that driver and executors have. Each document's ids, with ``end``
    behind, are compressed by themselves with the shared dictionary. Documents are dealt to ranges of
    ascending id, one file each; the manifest (bucket, path, documents, tokens, base) has the ids before
    each file, from totals per file. Texts are encoded before the only shuffle, which moves the frames.
    The dictionary is also written to the folder, as ``dictionary``.

    Null texts count as empty (the end id alone). Null ids come first. Rows of one id, or of none, are
    ordered by their texts' hash, and dealt by it to several files where they are very many. Texts are
    encoded whole, whatever their length; an empty table gives an empty manifest; other columns of
    ``docs`` are not read, whatever their names.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    n = partitions(docs)
    width = 2 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else 4
    folder = folder or workspace(spark, "tokens")
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dictionary = _dictionary(d, path, end, width)
    store, root = pafs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/dictionary") as f:
        f.write(dictionary)
    bucket, ranges = id_bucket(d, "id", n, F.xxhash64("text"))
    frames = d.select(bucket.alias("bucket"), "id", "text", F.xxhash64("text").alias("tie")).mapInArrow(partial(_frames, path=path, end=end, width=width, dictionary=dictionary), "bucket int, id bigint, tokens bigint, frame binary, tie bigint")
    files = frames.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", F.col("id").asc_nulls_first(), "tie", "frame")
    files = files.mapInArrow(partial(_save, folder=folder, width=width, dictionary_hash=hashlib.sha256(dictionary).digest()), "bucket bigint, path string, documents bigint, tokens bigint")
    manifest = written(files, "token-files")  # one row a file: few, whatever the number of documents
    base = F.sum("tokens").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(base, F.lit(0))), dictionary


def load(manifest: DataFrame, dictionary: bytes, id_col: str = "doc_id") -> DataFrame:
    """Reads token files: id_col, start (ids before the document), n_tokens, ids (little-endian unsigned 32-bit)."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = manifest.select("path", "base").repartition(n, "path")
    return rows.mapInArrow(partial(_read, dictionary=dictionary), "id bigint, start bigint, n_tokens bigint, ids binary").withColumnRenamed("id", id_col)
