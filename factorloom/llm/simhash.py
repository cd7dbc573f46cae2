"""SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sets, components, join_copies, partitions, written

#: Words to a shingle, most differing bits of linked fingerprints, seed of the shingles' hash.
SHINGLE_WORDS, MOST_BITS, SEED = 3, 2, 42
#: Shingles of one text hashed at a time; bounds memory for very long texts.
_CHUNK = 1 << 15
#: A bucket with more fingerprints is cut once more before its pairs are compared.
_LARGE = 1024

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash: a bit is set if it is in over half of the shingles' XXH64 (seed 42).

    A-Z are lower-cased; words are split at ASCII white space; a text of fewer words is one shingle;
    one without words, or null, has fingerprint 0.
    """
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return digest(b" ".join(w), SEED)
    n, ones = len(w) - words + 1, np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = w[at : min(at + _CHUNK, n) + words - 1]
        h = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(words)), strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.array([simhash(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["id", "fp"])


def _pairs(fp: np.ndarray, bits: int, sets: Sets, pieces: tuple[tuple[int, int], ...]) -> None:
    """Joins in ``sets`` all of ``fp`` within ``bits``; fp: distinct, and alike but for one bit in the part
    that ``pieces`` (shift, width) don't cover.

    A large group is cut by those pieces, one more than ``bits``: two within ``bits`` share one of them.
    """
    m = len(fp)
    if m > _LARGE and pieces:
        for shift, width in pieces:
            k = (fp >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            o = np.argsort(k, kind="stable")
            cuts = np.flatnonzero(np.diff(k[o])) + 1
            for part in np.split(o, cuts):
                if len(part) > 1:
                    _pairs(fp[part], bits, sets, ())
        return
    step = max(1, (1 << 20) // m)
    for at in range(0, m, step):
        near = np.bitwise_count(fp[at : at + step, None] ^ fp[None, :]) <= bits
        for i, j in zip(*np.nonzero(near), strict=True):
            if i + at < j:
                sets.join(int(fp[i + at]), int(fp[j]))


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """From rows (key, fp) sorted by key: a spanning forest of the links within buckets of one key."""
    sets = Sets()
    third = [(0, 11), (11, 11), (22, 10)] if bits == 2 else [(i * 32 // (bits + 1), (i + 1) * 32 // (bits + 1) - i * 32 // (bits + 1)) for i in range(bits + 1)]

    def close(key: int, fp: np.ndarray) -> None:
        other = 32 if (key >> 37) & 1 == 0 else 0  # the half that the key doesn't hold
        _pairs(np.unique(fp), bits, sets, tuple((s + other, w) for s, w in third))

    held_key, held = None, []
    for b in batches:
        key, fp = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
        if not len(key):
            continue
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        size = np.diff(cuts)
        inner = np.ones(len(size), bool)
        inner[[0, -1]] = False  # groups at the ends may go on in other batches
        two = np.flatnonzero(inner & (size == 2))
        x, y = fp[cuts[two]], fp[cuts[two] + 1]
        near = np.bitwise_count(x ^ y) <= bits
        for p, q in zip(x[near].tolist(), y[near].tolist(), strict=True):
            sets.join(p, q)
        for g in np.flatnonzero(inner & (size > 2)):
            close(int(key[cuts[g]]), fp[cuts[g] : cuts[g + 1]])
        for g in [0] if len(size) == 1 else [0, len(size) - 1]:
            k, part = int(key[cuts[g]]), fp[cuts[g] : cuts[g + 1]]
            if k != held_key:
                if held:
                    close(held_key, np.concatenate(held))
                held_key, held = k, []
            held.append(part)
    if held:
        close(held_key, np.concatenate(held))
    a = np.array(list(sets.up), np.uint64).view(np.int64)
    r = np.array([sets.root(x) for x in sets.up], np.uint64).view(np.int64)
    for at in range(0, len(a), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 10_000]), pa.array(r[at : at + 10_000])], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, bits: int = MOST_BITS) -> DataFrame:
    """Groups documents whose fingerprints are linked at ``bits`` or fewer differing bits (1 to 3).

    Returns id_col, fingerprint (16 hex digits), component_id: the smallest id reachable through links.
    The fingerprint's two halves are the segments: of at most three differing bits, one half has at most
    one, so each half is indexed under its 32 variants with one bit deleted, the variants are
    equality-joined and candidates verified. Only distinct fingerprints are indexed, so exact copies cost
    nothing there; within a bucket a spanning forest of the links is given out, never all pairs.

    Null texts count as empty; texts without words have fingerprint 0, linked like any other. Rows
    with a null id keep their row and take part; if no linked row has an id, component_id is null.
    Repeated rows stay. Texts count whole, whatever their length. An empty table gives an empty result;
    other columns of ``docs`` are not read, whatever their names.
    """
    if not 1 <= bits <= 3:
        raise ValueError("two segments serve 1 to 3 differing bits")
    n = partitions(docs)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    d = written(d.mapInArrow(partial(_fingerprints, words=words), f"id {id_type}, fp bigint"), "simhash")
    # Written and dealt anew: the fingerprints are small, but each becomes 64 variants.
    distinct = written(d.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "simhash-distinct")
    low = F.lit(0xFFFFFFFF)
    keys = []
    for seg in (0, 1):
        half = F.shiftrightunsigned("fp", 32 * seg).bitwiseAND(low)
        keys += [half.bitwiseAND(F.lit(0xFFFFFFFF ^ (1 << p))).bitwiseOR(F.lit((seg << 37) | (p << 32))) for p in range(32)]
    variants = distinct.repartition(n).select(F.explode(F.array(*keys)).alias("key"), "fp")
    links = variants.repartition(n, "key").sortWithinPartitions("key").mapInArrow(partial(_links, bits=bits), "a bigint, b bigint")
    links = written(links.distinct(), "simhash-links")
    reps = distinct.join(links.select(F.col("a").alias("fp")).union(links.select("b")).distinct(), "fp", "left_semi")
    reps = written(reps, "simhash-reps")
    roots = components(links, "simhash-components")
    in_groups = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root")).distinct()
    least = in_groups.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("component"))
    in_groups = in_groups.join(least, "root").select("fp", "component")
    named = distinct.join(in_groups, "fp", "left").select("fp", "copies", F.coalesce("component", "rep").alias("component_id"))
    out = join_copies(d, written(named, "simhash-named"), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
