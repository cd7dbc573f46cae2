"""Blocks of documents: words by number, so that distinct words move once a block and texts not at all.

A block is a run of whole documents of about BLOCK_BYTES. It becomes one row that holds each document's
word numbers, and one row for each part of the vocabulary that holds the block's distinct words whose
hash falls in that part. Parts meet in reducers, where each distinct word of the corpus is handled once;
answers go back by block. Numbers are ranks by frequency in the block, in byte planes under zstandard.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

#: Bytes of text to a block; a longer document is a block of its own.
BLOCK_BYTES = 16 << 20


def pack(values: np.ndarray, level: int = 1) -> bytes:
    """Unsigned integers below 2**64 as zstandard byte planes; as many planes as the largest needs."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=level).compress(planes.tobytes())


def unpack(data: bytes, dtype=np.int64) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view(np.uint64).reshape(-1).astype(dtype)


def pack_ranks(ranks: np.ndarray) -> bytes:
    """Ranks by frequency: one byte below 255, else 255 and the rest as byte planes of their own."""
    rare = ranks >= 255
    rest = pack(ranks[rare] - 255, 9)
    head = zstandard.ZstdCompressor(level=9).compress(np.where(rare, 255, ranks).astype(np.uint8).tobytes())
    return len(head).to_bytes(8, "little") + head + rest


def unpack_ranks(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]), np.uint8).astype(np.int32)
    out[out == 255] += unpack(data[8 + n :], np.int32)
    return out


def pack_documents(ranks: np.ndarray, part: np.ndarray) -> bytes:
    head = pack_ranks(ranks)
    return len(head).to_bytes(8, "little") + head + pack(part)


def unpack_documents(data: bytes) -> tuple[np.ndarray, dict[int, np.ndarray], int]:
    """All documents' ranks, the places() of the block's words, and how many distinct words there are."""
    n = int.from_bytes(data[:8], "little")
    part = unpack(data[8 + n :])
    return unpack_ranks(data[8 : 8 + n]), places(part), len(part)


def places(part: np.ndarray) -> dict[int, np.ndarray]:
    """The ranks of each part's words, in the order of that part's row."""
    order = np.argsort(part, kind="stable")
    names, first = np.unique(part[order], return_index=True)
    return dict(zip(names.tolist(), np.split(order, first[1:]), strict=True)) if len(part) else {}


def pack_many(*arrays: np.ndarray | bytes, level: int = 3) -> bytes:
    """Several packed arrays (or byte strings, at ``level``) in one, each with its length before it."""
    out = []
    for a in arrays:
        b = zstandard.ZstdCompressor(level=level).compress(a) if isinstance(a, bytes) else pack(a)
        out += [len(b).to_bytes(8, "little"), b]
    return b"".join(out)


def unpack_many(data: bytes, text: tuple[int, ...] = ()) -> list:
    """What pack_many packed; items of the positions in ``text`` are byte strings."""
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        b = data[at + 8 : at + 8 + n]
        out.append(zstandard.ZstdDecompressor().decompress(b) if len(out) in text else unpack(b))
        at += 8 + n
    return out


def pack_words(words: list[bytes]) -> tuple[np.ndarray, bytes]:
    return np.fromiter(map(len, words), np.int64, len(words)), b"".join(words)


def unpack_words(sizes: np.ndarray, data: bytes) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenation of the ranges starts[i] .. starts[i] + sizes[i]."""
    total = int(sizes.sum())
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(total) if total else np.zeros(0, np.int64)


def schema(id_type: str) -> str:
    """Rows of a block: part -1 holds the documents (ids, word counts, flags, ranks), part p >= 0 words."""
    return f"block bigint, part int, ids array<{id_type}>, sizes array<int>, flags array<boolean>, data binary"


def build(batches: Iterator[pa.RecordBatch], words_of: Callable[[str], Iterable[list]], parts: int, counts: bool, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From batches of (id, text, flag) to rows of schema(). ``words_of`` gives a text's words in lists.

    The documents' row holds the words' ranks and, by rank, each distinct word's part. A part's row holds
    its words in the order of their ranks: sizes, bytes and, if asked for, counts in documents flagged
    False. Block numbers come from the partition's number; write the rows before using them twice.
    """
    context = TaskContext.get()
    base, serial = (context.partitionId() if context else 0) << 24, count()
    ids, flags, held, numbers, vocab = [], [], 0, [], defaultdict(count().__next__)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal ids, flags, held, numbers, vocab
        block = base + next(serial)
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.concatenate(numbers) if numbers else np.zeros(0, np.uint32)
        n = len(vocab)
        freq = np.bincount(flat, minlength=n)
        by_rank = np.argsort(-freq, kind="stable")
        rank = np.empty(n, np.int64)
        rank[by_rank] = np.arange(n)
        seen = np.bincount(flat, weights=np.repeat(~np.array(flags, bool), sizes), minlength=n).astype(np.int64)[by_rank] if counts else None
        words = [w.encode("utf-8", "surrogatepass") if isinstance(w, str) else w for w in vocab]
        words = [words[i] for i in by_rank.tolist()]
        part = np.fromiter((crc32(w) % parts for w in words), np.int64, n)
        rows = [(block, -1, ids, sizes.tolist(), flags, pack_documents(rank[flat], part))]
        for p, o in places(part).items():
            rows.append((block, p, None, None, None, pack_many(*pack_words([words[i] for i in o]), *([seen[o]] if counts else []), level=9)))
        ids, flags, held, numbers, vocab = [], [], 0, [], defaultdict(count().__next__)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)

    for b in batches:
        for i, text, flag in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            text = text.as_py() or ""
            got = [np.fromiter(map(vocab.__getitem__, w), np.uint32, len(w)) for w in words_of(text)]
            ids.append(i)
            flags.append(bool(flag))
            numbers.append(got[0] if len(got) == 1 else np.concatenate(got) if got else np.zeros(0, np.uint32))
            held += len(text) + 16
            if held >= BLOCK_BYTES:
                yield from close()
    if ids:
        yield from close()


def texts(batches: Iterator[pa.RecordBatch], out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks of whole texts (null: empty) as they are, under zstandard: (block, ids, data, and the batches'
    third column, if any, as a list)."""
    context = TaskContext.get()
    base, serial = (context.partitionId() if context else 0) << 24, count()
    ids, held, extra, size = [], [], [], 0

    def close() -> pa.RecordBatch:
        data = pack_many(np.fromiter(map(len, held), np.int64, len(held)), b"".join(held))
        row = (base + next(serial), ids, data, extra)[: len(out.types)]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, out.types, strict=True)], schema=out)

    for b in batches:
        more = b.column(2).to_pylist() if b.num_columns > 2 else [None] * len(b)
        for i, text, x in zip(b.column(0).to_pylist(), b.column(1), more, strict=True):
            ids.append(i)
            extra.append(x)
            held.append((text.as_py() or "").encode("utf-8", "surrogatepass"))
            size += len(held[-1]) + 16
            if size >= BLOCK_BYTES:
                yield close()
                ids, held, extra, size = [], [], [], 0
    if ids:
        yield close()


def open_texts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A block's raw bytes, and where its documents begin (with the end)."""
    sizes, raw = unpack_many(data, (1,))
    return np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum(sizes)]


def id_order(ids: list) -> np.ndarray:
    """Ids as integers; those of null come last."""
    return np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64)


def pack_runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> bytes:
    """Runs sorted by document: documents as gaps, starts, windows, then the number of runs in 8 bytes."""
    return pack_many(np.diff(doc.astype(np.int64), prepend=0), start, n) + len(doc).to_bytes(8, "little")


def unpack_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Documents, starts, windows, and the number of runs."""
    m = int.from_bytes(data[-8:], "little")
    doc, start, n = unpack_many(data[:-8])
    return np.cumsum(doc), start, n, m
