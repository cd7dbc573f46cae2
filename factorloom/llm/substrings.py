"""Removal of repeated byte strings: most-significant-digit passes over suffixes, only to the threshold's depth."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import blocks
from .common import by_part, grouped, partitions, written

#: Bytes of a repeated string, and of the first digit that suffixes are dealt by.
LENGTH, DIGIT = 100, 32
#: Bytes hashed at a time (must stay below 2**22).
_CHUNK = 1 << 20
_LOW = np.uint64((1 << 22) - 1)

#: Runs of one first digit beyond which its windows are dealt one by one.
LARGE = 256
#: Bytes to a digit of the last passes.
_WORD = 8

_RUN = np.dtype([("gram", "<u8"), ("span", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("n", "<u4")])


@cache
def _powers(n: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of an odd base and their inverses, modulo 2**64."""
    rng = np.random.default_rng(seed)
    base = int(rng.integers(1 << 62)) * 2 + 1
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])
        down = np.cumprod(np.r_[np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)])
    return rng.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1), up, down


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def _prefix(raw: np.ndarray, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of byte values times powers; with the inverse powers they hash any range."""
    values, up, down = _powers(_CHUNK + (1 << 12) if len(raw) <= _CHUNK + (1 << 12) else len(raw), seed)
    with np.errstate(over="ignore"):
        return np.r_[np.uint64(0), np.cumsum(values[raw] * up[: len(raw)])], down


def _range_hash(sums: np.ndarray, down: np.ndarray, start: np.ndarray, size) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (sums[start + size] - sums[start]) * down[start]


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` neighbours, in linear time."""
    n = len(h)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = h
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def runs_of(raw: np.ndarray, length: int, digit: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of ``length`` bytes that hold the same least ``digit``-byte string.

    A window's least string depends on its bytes alone, so equal windows, wherever they are, lie at the
    same place in runs of the same string. Returns gram, span, start, n: the string's hash, the hash of
    all bytes of the run and the string's place in it, the first window's start, the number of windows.
    """
    if len(raw) < length:
        e = np.zeros(0, np.uint64)
        return e, e, e.astype(np.int64), e.astype(np.int64)
    sums, down = _prefix(raw)
    grams = _mix(_range_hash(sums, down, np.arange(len(raw) - digit + 1), digit))
    keys = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    at = (_least(keys, length - digit + 1) & _LOW).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    n = np.diff(np.r_[first, len(at)])
    span = _range_hash(sums, down, first, n + length - 1)
    span = _mix(span ^ _mix((((at[first] - first) << 32) | n).astype(np.uint64)))
    return grams[at[first]], span, first, n


def _document_runs(raw: np.ndarray, length: int, digit: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a whole document, in chunks of windows."""
    for at in range(0, max(len(raw) - length + 1, 0), _CHUNK):
        g, s, start, n = runs_of(raw[at : at + _CHUNK + length - 1], length, digit)
        yield g, s, start + at, n


def _scan(batches: Iterator[pa.RecordBatch], length: int, digit: int, parts: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """First pass, block by block: rows of runs by part; runs met before in the block are removed at once.

    The row of a part below 0 holds what is removed already: document, start, windows.
    """
    for b in batches:
        for block, ids, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw, cuts = blocks.open_texts(data)
            found = []
            for d in range(len(ids)):
                for g, s, start, n in _document_runs(raw[cuts[d] : cuts[d + 1]], length, digit):
                    r = np.empty(len(g), _RUN)
                    r["gram"], r["span"], r["doc"], r["start"], r["n"] = g, s, d, start, n
                    found.append(r)
            runs = np.concatenate(found) if found else np.zeros(0, _RUN)
            key = blocks.id_order(ids)
            o = np.lexsort((runs["start"], runs["doc"], key[runs["doc"]], runs["span"], runs["gram"]))
            runs = runs[o]
            again = np.r_[False, (runs["gram"][1:] == runs["gram"][:-1]) & (runs["span"][1:] == runs["span"][:-1])] if len(runs) else np.zeros(0, bool)
            gone, kept = runs[again], runs[~again]
            gone = gone[np.argsort(gone["doc"], kind="stable")]
            rows = [(block, -1 - block % (1 << 30), None, blocks.pack_runs(gone["doc"], gone["start"], gone["n"]))]
            part = (kept["gram"] >> np.uint64(20)) % np.uint64(parts)
            o = np.lexsort((kept["start"], kept["doc"], part))
            kept, part = kept[o], part[o]
            for p, at in blocks.places(part.astype(np.int64)).items():
                r = kept[at]
                mine = r["doc"].astype(np.int64)
                rows.append((block, p, [ids[i] for i in mine[np.r_[True, mine[1:] != mine[:-1]]]], r["gram"].tobytes() + r["span"].tobytes() + blocks.pack_runs(mine, r["start"], r["n"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)


def _dealt(table: pa.Table, large: int, out: pa.Schema) -> pa.Table:
    """Second pass, part by part: equal runs keep their first, all others are removed (kind 0). First ones whose
    digit others have too are asked for: kind 1, or kind 2 where the digit has very many of them."""
    if table["part"][0].as_py() < 0:
        rows = [(b, p, 0, d) for b, p, d in zip(table["block"].to_pylist(), table["part"].to_pylist(), table["data"].to_pylist(), strict=True)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)
    found, names, lists = [], [], zip(table["block"].to_pylist(), table["ids"].to_pylist(), table["data"].to_pylist(), strict=True)
    for i, (block, ids, data) in enumerate(lists):
        m = int.from_bytes(data[-8:], "little")
        doc, start, n, _ = blocks.unpack_runs(data[16 * m :])
        owner = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
        found.append((np.frombuffer(data, "<u8", m), np.frombuffer(data, "<u8", m, 8 * m), blocks.id_order(ids)[owner], doc, start, n, np.full(m, i)))
        names.append(block)
    gram, span, key, doc, start, n, owner = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((start, doc, owner, key, span, gram))
    gram, span, doc, start, n, owner = (x[o] for x in (gram, span, doc, start, n, owner))
    new_gram = np.r_[True, gram[1:] != gram[:-1]]
    first = new_gram | np.r_[True, span[1:] != span[:-1]]
    spans = np.add.reduceat(first.astype(np.int64), np.flatnonzero(new_gram))[np.cumsum(new_gram) - 1]
    out_rows = []
    for kind, pick in ((0, ~first), (1, first & (spans > 1) & (spans <= large)), (2, first & (spans > large))):
        x = np.flatnonzero(pick)
        x = x[np.lexsort((start[x], doc[x], owner[x]))]
        cuts = np.searchsorted(owner[x], np.arange(len(names) + 1))
        for i, block in enumerate(names):
            y = x[cuts[i] : cuts[i + 1]]
            if len(y):
                out_rows.append((block, int(table["part"][0].as_py()), kind, blocks.pack_runs(doc[y], start[y], n[y])))
    return pa.Table.from_arrays([pa.array([r[c] for r in out_rows], t) for c, t in enumerate(out.types)], schema=out)


def _in_turn(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring items of about _CHUNK bytes in all, so that powers stay few."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _CHUNK, "right")))
        yield lo, hi
        lo = hi


def second_digit(text: np.ndarray, begin: np.ndarray, n: np.ndarray, length: int, digit: int) -> tuple[np.ndarray, ...]:
    """Cuts runs (of ``n`` windows, their bytes at ``begin`` of ``text``) at the place of their first digit:
    run, first window, windows, key.

    Windows with most of what they hold beside the first digit behind it have the bytes there for their
    second digit, the others the bytes before it. Equal windows have equal keys.
    """
    sums, down = _prefix(text)
    half = (length - digit) // 2
    grams = _mix(_range_hash(sums, down, np.arange(len(text) - digit + 1), digit))
    place = begin + (grams[begin[:, None] + np.arange(length - digit + 1)] >> np.uint64(22)).argmin(1)
    cut = np.clip(place - begin - half, 0, n)
    behind = _mix(_range_hash(sums, down, np.minimum(place + digit, len(text) - (length - digit - half)), length - digit - half))
    before = _mix(_range_hash(sums, down, np.maximum(place - half, 0), half) + np.uint64(1))
    run = np.arange(len(n))
    first = np.r_[np.zeros(len(n), np.int64), cut]
    many = np.r_[cut, n - cut]
    key = _mix(np.r_[grams[place], grams[place]] ^ np.r_[before, behind])
    there = many > 0
    return np.r_[run, run][there], first[there], many[there], key[there]


def _asked(table: pa.Table, length: int, digit: int, parts: int, out: pa.Schema) -> pa.Table:
    """Third pass, block by block: the runs asked for, dealt by their second digit with their bytes (kind 1), or as
    single windows by 128 bits of their hashes (kind 2)."""
    kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
    block, rows = table["block"][0].as_py(), []
    at = kinds.index(-1)
    for kind in (1, 2):
        asked = [blocks.unpack_runs(d)[:3] for k, d in zip(kinds, data, strict=True) if k == kind]
        if not asked:
            continue
        ids = table["ids"][at].as_py()
        raw, cuts = blocks.open_texts(data[at])
        doc, start, n = (np.concatenate(x) for x in zip(*asked, strict=True))
        found = []
        for lo, hi in _in_turn(n + length - 1):
            size = n[lo:hi] + length - 1
            text = raw[blocks.ragged(cuts[doc[lo:hi]] + start[lo:hi], size)]
            begin = np.r_[0, np.cumsum(size)[:-1]]
            if kind == 1:
                run, first, many, key = second_digit(text, begin, n[lo:hi], length, digit)
                other = key
            else:
                run = np.repeat(np.arange(hi - lo), n[lo:hi])
                first, many, place = blocks.ragged(np.zeros(hi - lo, np.int64), n[lo:hi]), np.ones(len(run), np.int64), blocks.ragged(begin, n[lo:hi])
                key, other = (_mix(_range_hash(*_prefix(text, seed), place, length)) for seed in (20, 21))
            found.append((doc[lo:hi][run], start[lo:hi][run] + first, many, key, other))
        doc, start, n, key, other = (np.concatenate(x) for x in zip(*found, strict=True))
        part = ((key >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
        o = np.lexsort((start, doc, part))
        doc, start, n, key, other, part = (x[o] for x in (doc, start, n, key, other, part))
        for p, y in blocks.places(part).items():
            mine = doc[y][np.r_[True, doc[y][1:] != doc[y][:-1]]]
            keys = key[y].tobytes() + (other[y].tobytes() if kind == 2 else b"")
            text = zstandard.ZstdCompressor(level=1).compress(raw[blocks.ragged(cuts[doc[y]] + start[y], n[y] + length - 1)].tobytes()) if kind == 1 else None
            rows.append((block, p, kind, [ids[i] for i in mine], keys + blocks.pack_runs(doc[y], start[y], n[y]), text))
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def repeated_suffixes(raw: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Orders suffixes (at ``start``, those of one ``group`` together) through their first ``length`` bytes.

    Most significant digit first, _WORD bytes to a digit: each pass orders what is left by group and
    digit, groups of one go no further, and groups that are left after the last pass are exactly the
    suffixes that have ``length`` bytes in common. Returns their places in ``start``, and groups.
    """
    left = np.arange(len(start))
    for at in range(0, length, _WORD):
        word = np.zeros(len(left), np.uint64)
        for j in range(at, min(at + _WORD, length)):
            word = (word << np.uint64(8)) | raw[start[left] + j]
        o = np.lexsort((word, group))
        group, word = group[o], word[o]
        number = np.cumsum(np.r_[False, (group[1:] != group[:-1]) | (word[1:] != word[:-1])]) if len(o) else o
        many = np.bincount(number, minlength=1)[number] > 1
        left, group = left[o][many], number[many]
    return left, group


def _windows(table: pa.Table, length: int, out: pa.Schema) -> pa.Table:
    """Last passes, part by part: of equal windows of the runs that were asked for, all but the first are removed."""
    names, rows = table["block"].to_pylist(), []
    for kind in (1, 2):
        found, texts = [], []
        for i, (k, ids, data, text) in enumerate(zip(*(table[c].to_pylist() for c in ("kind", "ids", "data", "text")), strict=True)):
            if k != kind:
                continue
            m = int.from_bytes(data[-8:], "little")
            doc, start, n, _ = blocks.unpack_runs(data[8 * kind * m :])
            own = blocks.id_order(ids)[np.cumsum(np.r_[False, doc[1:] != doc[:-1]])]
            found.append((np.frombuffer(data, np.uint64, m), np.frombuffer(data, np.uint64, m, 8 * (kind - 1) * m), own, doc, start, n, np.full(m, i)))
            if kind == 1:
                texts.append(np.frombuffer(zstandard.ZstdDecompressor().decompress(text), np.uint8))
        if not found:
            continue
        key, other, own, doc, start, n, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        if kind == 1:
            raw = np.concatenate(texts)
            begin = np.r_[0, np.cumsum(n + length - 1)[:-1]]
            _, group, times = np.unique(key, return_inverse=True, return_counts=True)
            open_ = np.flatnonzero(times[group] > 1)
            run = np.repeat(open_, n[open_])
            inside = blocks.ragged(np.zeros(len(open_), np.int64), n[open_])
            left, group = repeated_suffixes(raw, begin[run] + inside, group[run], length)
            run, start = run[left], start[run[left]] + inside[left]
            own, doc, owner = own[run], doc[run], owner[run]
        else:
            o = np.lexsort((other, key))
            group = np.empty(len(o), np.int64)
            group[o] = np.cumsum(np.r_[False, (key[o][1:] != key[o][:-1]) | (other[o][1:] != other[o][:-1])])
        o = np.lexsort((start, doc, np.array(names, np.int64)[owner], own, group))
        x = o[np.r_[False, group[o][1:] == group[o][:-1]]] if len(o) else o
        x = x[np.lexsort((start[x], doc[x], owner[x]))]
        cuts = np.searchsorted(owner[x], np.arange(len(names) + 1))
        for i, block in enumerate(names):
            y = x[cuts[i] : cuts[i + 1]]
            if len(y):
                rows.append((block, table["part"][0].as_py(), 0, blocks.pack_runs(doc[y], start[y], np.ones(len(y), np.int64))))
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def _cut(table: pa.Table, length: int, out: pa.Schema) -> pa.Table:
    """A block's documents without the bytes of removed windows."""
    kinds, data = table["kind"].to_pylist(), table["data"].to_pylist()
    at = kinds.index(-1)
    ids = table["ids"][at].as_py()
    raw, cuts = blocks.open_texts(data[at])
    change = np.zeros(len(raw) + 1, np.int32)
    for kind, d in zip(kinds, data, strict=True):
        if kind == 0:
            doc, start, n, m = blocks.unpack_runs(d)
            if m:
                np.add.at(change, cuts[doc] + start, 1)
                np.add.at(change, cuts[doc] + start + n + length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    rows = []
    for i, d in enumerate(ids):
        g = gone[cuts[i] : cuts[i + 1]]
        edge = np.flatnonzero(np.diff(np.r_[False, g, False].astype(np.int8)))
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
        rows.append((d, len(g), spans, raw[cuts[i] : cuts[i + 1]][~g].tobytes()))
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, digit: int = DIGIT, large: int = LARGE) -> DataFrame:
    """Takes out each byte that lies in a ``length``-byte string which also starts earlier.

    Earlier: in a row of smaller id, or in the same row before; strings are those of the input, overlaps
    count, matches lie within one row. Returns id_col, n_bytes, spans (array of start, end: the
    removed runs), kept (the other bytes).

    Suffixes are ordered only as deep as ``length``, in passes of most significant digit first; suffixes
    that are alone with their digits go no further, and equal groups of the last pass are exactly the
    repeated strings. To order every suffix moves several times the text, so neighbours that are bound
    to part together go as one: the first digit of a window is its least ``digit``-byte string (least by
    hash), wherever in the window it is, and one row stands for a run of neighbouring windows (about 35)
    that share it. Runs whose first digit is unique are done. Of equal runs (by 128 bits) the first stays
    and goes on; runs that share the first digit only go on to the second, the bytes next to it on the
    side where a window holds more of them, by which they are dealt with their bytes; there windows are
    ordered byte by byte, _WORD bytes a pass. Where a first digit has more than ``large`` different runs (a
    line that all documents have), its windows are dealt one by one by their own hash, 128 bits, so no group
    is large. Copies within a block are settled before anything moves, so a passage that all documents
    share moves once a block.

    Ids are integers. Null ids come last; rows of one id, or of none, follow the order in which their
    blocks were read. Null and empty texts lose nothing. Texts are taken whole, whatever their length. An
    empty table gives an empty result; other columns are not read, whatever their names.
    """
    if not 8 <= digit <= length <= 1024:
        raise ValueError("strings of 8 to 1024 bytes, with a digit of 8 bytes to as many, are served")
    n = partitions(docs)
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    body = "block bigint, ids array<bigint>, data binary"
    whole = written(d.mapInArrow(partial(blocks.texts, out=arrow(body)), body), "repeats-blocks", "uncompressed")
    runs = "block bigint, part int, ids array<bigint>, data binary"
    found = whole.mapInArrow(partial(_scan, length=length, digit=digit, parts=n, out=arrow(runs)), runs)
    answer = "block bigint, part int, kind int, data binary"
    dealt = written(by_part(found, n).applyInArrow(grouped(_dealt, large=large, out=arrow(answer)), answer), "repeats-runs", "uncompressed")
    text = whole.select("block", F.lit(-1).alias("part"), F.lit(-1).alias("kind"), "ids", "data")
    request = "block bigint, part int, kind int, ids array<bigint>, data binary, text binary"
    asked = text.unionByName(dealt.where("kind > 0"), allowMissingColumns=True).groupBy("block").applyInArrow(grouped(_asked, length=length, digit=digit, parts=n, out=arrow(request)), request)
    single = by_part(asked, n).applyInArrow(grouped(_windows, length=length, out=arrow(answer)), answer)
    single = written(single, "repeats-windows", "uncompressed")
    gone = dealt.where("kind = 0").unionByName(single)
    out = "id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    kept = text.unionByName(gone, allowMissingColumns=True).groupBy("block").applyInArrow(grouped(_cut, length=length, out=arrow(out)), out)
    return kept.withColumnRenamed("id", id_col)
