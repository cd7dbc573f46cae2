"""Byte-level BPE: distinct words are encoded once for the whole corpus; ids decode by the token-byte table."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import partitions, streamed, written

#: Parts of the vocabulary at most, so that a block's row for a part stays some kilobytes; reducers take rows as they come.
MOST_PARTS = 2048
#: Most words that a reducer remembers; a word met again later than so many others is encoded again.
_REMEMBERED = 1 << 20
#: Longer texts are split into words so many at a time.
_LONG = 1 << 20
#: Bytes of ids that a worker hands over at a time.
_SENT = 2 << 20


@cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@cache
def _table(path: str) -> list[bytes]:
    """Bytes of each token id: as large as the vocabulary, whatever the corpus."""
    ranks = _ranks(path)
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for k, v in ranks.items():
        out[v] = k
    return out


def _words(pattern: str, text: str) -> Iterator[list[str]]:
    import regex

    found = regex.compile(pattern)
    if len(text) <= _LONG:
        yield found.findall(text)
        return
    some: list[str] = []
    for m in found.finditer(text):
        some.append(m[0])
        if len(some) == _LONG:
            yield some
            some = []
    yield some


def _encode_words(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Rows of words to rows of ids: (block, part, data: ids per word, ids)."""
    encode = _encoding(path, pattern)._encode_single_piece
    known: dict[bytes, list[int]] = {}
    for b in batches:
        out = []
        for data in b.column(2).to_pylist():
            sizes, raw = blocks.unpack_many(data, (1,))
            ids = []
            for w in blocks.unpack_words(sizes, raw):
                got = known.get(w)
                if got is None:
                    if len(known) >= _REMEMBERED:
                        known.clear()
                    got = known[w] = encode(w)
                ids.append(got)
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum()))
            width = 2 if flat.max(initial=0) < 1 << 16 else 4
            out.append(blocks.pack_many(n, bytes([width]) + flat.astype(f"<u{width}").tobytes(), level=9))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["block", "part", "data"])


def _assemble(batches: Iterator[pa.RecordBatch], out: pa.Schema, path: str) -> Iterator[pa.RecordBatch]:
    """One block's rows to its documents' ids, by position, and the bytes of those ids if ``out`` has them."""
    table = pa.Table.from_batches(batches)
    part, data = table["part"].to_pylist(), table["data"].to_pylist()
    doc = part.index(-1)
    ranks, places, total = blocks.unpack_documents(data[doc])
    n_words, starts = np.zeros(total, np.int64), np.zeros(total, np.int64)
    at, flat = 0, []
    for p, d in zip(part, data, strict=True):
        if p >= 0:
            n, raw = blocks.unpack_many(d, (1,))
            ids = np.frombuffer(raw, f"<u{raw[0]}", offset=1)
            n_words[places[p]] = n
            starts[places[p]] = at + np.r_[0, np.cumsum(n)[:-1]]
            at += len(ids)
            flat.append(ids.astype("<u4"))
    flat = np.concatenate(flat) if flat else np.zeros(0, "<u4")
    del data
    ids, sizes = table["ids"][doc].as_py(), table["sizes"][doc].as_py()
    decode = _table(path) if out.names[-1] == "decoded" else None
    at = 0
    rows: list[tuple] = []
    held = 0
    for i, n in zip(ids, sizes, strict=True):
        pieces = []
        for lo in range(at, at + n, _LONG):
            r = ranks[lo : min(lo + _LONG, at + n)]
            pieces.append(flat[blocks.ragged(starts[r], n_words[r])].tobytes())
        at += n
        found = b"".join(pieces)
        rows.append((i, len(found) // 4, found, *([_bytes(found, decode)] if decode else [])))
        held += len(found)
        if held > _SENT:
            yield _batch(rows, out)
            rows, held = [], 0
    if rows:
        yield _batch(rows, out)


def _batch(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def _bytes(ids: bytes, table: list[bytes]) -> bytes:
    """What ids, as stored, stand for."""
    return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Each whole text's token ids: id_col, n_tokens, ids (little-endian unsigned 32-bit, as binary).

    ``decoded`` adds the column of that name: what decode() makes of the ids, in the same worker.
    ``path`` names a file of ranks that driver and executors have, ``pattern`` the pre-tokenizer; each of
    its matches is encoded separately, without special tokens.

    Pre-tokens are numbered by position, block by block (blocks.py); each block's distinct ones are dealt
    by hash over the cluster, where each is encoded once; ids go back to the blocks and are put together
    by position. What moves is the vocabulary of each block and compact positions, never a row a word,
    and a word that is in every document moves once a block. Null texts count as empty (no ids); null
    ids and repeated rows keep their row. Texts are encoded whole, whatever their length. An empty table
    gives an empty result; other columns are not read, whatever their names.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    n = min(partitions(docs), MOST_PARTS)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.lit(False).alias("flag"))
    id_type = d.schema["id"].dataType.simpleString()
    rows = _rows(d, partial(_words, pattern), n, blocks.schema(id_type), "bpe-blocks")
    coded = rows.where("part >= 0").select("block", "part", "data").repartitionById(n, F.col("part"))
    coded = coded.mapInArrow(partial(_encode_words, path=path, pattern=pattern), "block bigint, part int, data binary")
    both = rows.where("part < 0").select("block", "part", "ids", "sizes", "data").unionByName(coded, allowMissingColumns=True)
    out = f"id {id_type}, n_tokens bigint, ids binary" + (", decoded binary" if decoded else "")
    arrow = to_arrow_schema(_struct(out))
    return both.groupBy("block").applyInArrow(streamed(_assemble, out=arrow, path=path), out).withColumnRenamed("id", id_col)


def _struct(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def _rows(d: DataFrame, words_of, n: int, ddl: str, name: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_struct(ddl))
    return written(d.mapInArrow(partial(_built, words_of=words_of, parts=n, out=arrow), ddl), name)


def _built(batches, words_of, parts, out):
    return blocks.build(batches, words_of, parts, False, out)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, at: int, out: list[str]) -> Iterator[pa.RecordBatch]:
    table = _table(path)
    for b in batches:
        text = [_bytes(x.as_py() or b"", table) for x in b.column(at)]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.binary())], out)


def decode(tokens: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that its ids stand for, by the token-byte table of ``path``; null ids: none."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema) + f", `{out_col}` binary"
    return tokens.mapInArrow(partial(_decoded, path=path, at=tokens.columns.index(ids_col), out=[*tokens.columns, out_col]), ddl)
