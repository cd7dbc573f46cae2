"""Near-duplicates by exact Jaccard similarity; candidates are deletion variants of segments of a wide SimHash.

As in ``simhash``, a bit of the fingerprint is one that over half of the shingles have. At a Jaccard similarity of 0.8 about
15 % of bits differ, so the fingerprint has many segments, as many as let all but MISSED of such pairs differ by one bit at
most in one of them. Sets of shingles move only for texts that such a segment brings together and whose sketches agree. Pairs
are looked at where a task holds both texts: what is given out joins texts to regions, and no table has a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sets, join_copies, partitions, written
from .forest import LARGE_SHINGLES, MISSED, NEIGHBOURS, SHINGLE_WORDS, SLACK, _by_region, _near, _sets, alike, filtered, named_groups, shingles, stars
from .simhash import SEED

SIMILARITY = (4, 5)
#: Bits of a segment of which one may differ: each is deleted in turn. The segment's other bits, which deal it to tasks, are equal.
REST = 12
#: Bits that travel with each segment, to tell pairs apart that share one by chance.
SKETCH = 192
#: In sets of so many shingles more bits differ at one similarity than in larger ones; they have further segments.
FEW = 5
#: Segments in which each text is first compared with those beside it only.
FIRST_SEGMENTS = 12
#: Texts that pairs hold together are one task's if they are no more, and have no more than LARGE_SHINGLES.
LARGE = 1024
#: A group of one variant that is larger is compared by what lies outside its largest group of linked texts.
_BROAD = 256


def differing(a: int, b: int, common: int) -> float:
    """Probability that a bit differs between sets of ``a`` and ``b`` shingles, ``common`` of them shared."""

    def bits(n: int) -> np.ndarray:
        return np.array([math.comb(n, i) for i in range(n + 1)]) / 2.0**n

    def over(n: int, own: int) -> np.ndarray:
        """For each count among the shared ones: that over half of all n have the bit, ``own`` of them not shared."""
        tail = np.r_[bits(own)[::-1].cumsum()[::-1], 0.0]
        return tail[np.clip(n // 2 + 1 - np.arange(common + 1), 0, own + 1)]

    x, y = over(a, a - common), over(b, b - common)
    return float((bits(common) * (x * (1 - y) + y * (1 - x))).sum())


@lru_cache
def most_differing(similarity: tuple[int, int] = SIMILARITY) -> tuple[float, float]:
    """The largest share of bits that differ at ``similarity`` or more: between sets of more than FEW shingles, of FEW at most."""
    part, whole = similarity
    found = [1e-9, 1e-9]
    for b in range(1, 65):
        for a in range(1, b + 1):
            common = -(-part * (a + b) // (part + whole))  # the least
            if common <= a and not a == b == common:
                at = int(b <= FEW)
                found[at] = max(found[at], differing(a, b, common))
    found[0] = max(found[0], math.acos(2 * part / (part + whole)) / math.pi)  # of very many
    return found[0], max(found)


def segments(differ: float, exact: int, missed: float = MISSED) -> int:
    """Segments in one of which all but ``missed`` of the pairs have ``exact`` equal bits and one other of REST at most."""
    met = (1 - differ) ** (exact + REST) * (1 + REST * differ / (1 - differ))
    return math.ceil(math.log(missed) / math.log1p(-met))


def furthest(differ: float, bits: int) -> int:
    """Differing bits beyond which a pair isn't taken up."""
    return math.floor(bits * differ + SLACK * math.sqrt(bits * differ * (1 - differ)))


def fingerprint(h: np.ndarray, bits: int) -> bytes:
    """At least ``bits`` bits, in whole words: each is set if over half of the shingles ``h`` have it. More bits begin with the same ones."""
    words = -(-bits // 64)
    ones = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(h), 255):
        z = h[at : at + 255, None] + salt  # SplitMix64
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(z.view(np.uint8).reshape(len(z), -1), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def _sketched(batches: Iterator[pa.RecordBatch], words: int, bits: int, few_bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, sizes, prints = [], [], []
        for text in b.column(1):
            h = shingles(text.as_py(), words)
            fps.append(xxhash.xxh3_64_intdigest(h.tobytes(), SEED))
            sizes.append(len(h))
            prints.append(fingerprint(h, few_bits if len(h) <= FEW else bits) if len(h) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), b.column(1)], ["id", "fp", "n", "bits", "text"])


def _segmented(batches: Iterator[pa.RecordBatch], exact: int, counts: tuple[int, int], start: int) -> Iterator[pa.RecordBatch]:
    """Rows (fp, n, bits, root) to a row for each segment from ``start`` on: its number and equal bits, the others (and whether the set
    has few shingles), the sketch. counts: segments of sets of more than FEW shingles, of others, with those before ``start``."""
    width = exact + REST
    for whole in batches:
        for at in range(0, len(whole), 1024):
            b = whole.slice(at, 1024)
            few = b.column(1).to_numpy() <= FEW
            for some, count, flag in ((~few, counts[0], 0), (few, counts[1], 1 << REST)):
                if not some.any() or count <= start:
                    continue
                own = b.filter(pa.array(some))
                raw = np.frombuffer(b"".join(own.column(2).to_pylist()), np.uint8).reshape(len(own), -1)
                sketch = np.ascontiguousarray(raw[:, : SKETCH // 8]).view(np.int64)
                bits = np.unpackbits(raw[:, SKETCH // 8 :], axis=1, bitorder="little", count=count * width).reshape(len(own), count, width)
                value = np.zeros((len(own), count - start), np.int64)
                for i in range(width):
                    value = (value << 1) | bits[:, start:, i]
                key = (np.arange(start, count) << exact) | (value >> REST)
                cols = [key.ravel(), ((value & ((1 << REST) - 1)) | flag).ravel()]
                cols += [np.repeat(c, count - start) for c in (*sketch.T, own.column(0).to_numpy(), own.column(3).to_numpy())]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "rest", "lo", "hi", "more", "fp", "root"])


def _sections(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows sorted by key to the columns beside it, key by key."""
    held_key, held = None, []
    for b in batches:
        key, *cols = (c.to_numpy() for c in b.columns)
        cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            if lo == hi:
                continue
            if key[lo] != held_key and held:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            held_key = key[lo]
            held.append([c[lo:hi] for c in cols])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def variants(rest: np.ndarray, lo: np.ndarray, hi: np.ndarray, root: np.ndarray, most: tuple[int, int], beside: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, differing bits of the sketches) of different roots that have a variant in common, by the bit that is deleted.

    most: differing bits of a pair's sketches at most, where a set has more than FEW shingles and where both have no more. With
    ``beside``, of those of one variant each is compared with so many before it in order of sketches. A pair is given once.
    Roots may be joined in place (in ``root``) between pairs: what has one root by then isn't compared any more.
    """
    lo, hi = lo.view(np.uint64), hi.view(np.uint64)
    few, rest = rest >> REST, rest & ((1 << REST) - 1)

    def near(i: np.ndarray, j: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        between = rest[i] ^ rest[j]
        at = (root[i] != root[j]) & ((between == 1 << bit) | ((between == 0) & (bit == 0)))
        i, j = i[at], j[at]
        bits = np.bitwise_count(lo[i] ^ lo[j]).astype(np.int64) + np.bitwise_count(hi[i] ^ hi[j])
        at = bits <= np.where(few[i] & few[j], most[1], most[0])
        return i[at], j[at], bits[at]

    for bit in range(REST):
        key = rest & ~(1 << bit)
        order = np.lexsort((hi, key)) if beside else np.argsort(key, kind="stable")
        key = key[order]
        start = np.r_[0, np.flatnonzero(np.diff(key)) + 1]
        end = np.r_[start[1:], len(key)]
        last = np.repeat(end, end - start)
        i = np.arange(len(key))
        if not beside:
            for g in np.flatnonzero(end - start > _BROAD):
                own, step = order[start[g] : end[g]], 1
                while True:
                    _, place, count = np.unique(root[own], return_inverse=True, return_counts=True)
                    others = np.flatnonzero(place != count.argmax())
                    if not len(others):
                        break
                    x = others[:step]
                    yield near(*_crossed(own, x), bit)
                    own, step = np.delete(own, x), min(2 * step, max(1, (1 << 20) // len(own)))
            i = i[np.repeat(end - start <= _BROAD, end - start)]
        offset = 1
        while len(i := i[i + offset < last[i]]) and (not beside or offset <= beside):
            yield near(order[i], order[i + offset], bit)
            offset += 1


def _crossed(own: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``x`` (places in ``own``) with all others, those of two of ``x`` once."""
    after = np.ones((len(x), len(own)), bool)
    after[:, x] = x[None, :] > x[:, None]
    i, j = np.nonzero(after)
    return own[x[i]], own[j]


def joined(rest: np.ndarray, lo: np.ndarray, hi: np.ndarray, more: np.ndarray, root: np.ndarray, most: tuple[int, int]) -> list[tuple[int, int]]:
    """Roots that hold together by variants in common and near sketches: fewer pairs of them than there are roots."""
    names, own = np.unique(root, return_inverse=True)
    up, now, few, further, links = np.arange(len(names)), own.astype(np.int64), rest >> REST, more.view(np.uint64), []
    for i, j, bits in variants(rest, lo, hi, now, most):
        at = bits + np.bitwise_count(further[i] ^ further[j]) <= np.where(few[i] & few[j], most[1], most[0])
        if not at.any():
            continue
        for pair in np.unique(now[i[at]] * len(names) + now[j[at]]).tolist():
            x, y = divmod(pair, len(names))
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((int(names[x]), int(names[y])))
        while (up[up] != up).any():
            up = up[up]
        now[:] = up[own]
    return links


def _edges(links: list[tuple[int, int]], sets: Sets) -> Iterator[pa.RecordBatch]:
    links = [x for x in links if sets.join(*x)]
    if links:
        a, b = zip(*links, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.nulls(len(a), pa.int64())], ["a", "b", "bits"])


def _beside(batches: Iterator[pa.RecordBatch], most: tuple[int, int], whole: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Of each text the NEIGHBOURS nearest of those beside it: (a, b, bits), and what holds together: (a, b, null)."""
    sets = Sets()
    for rest, lo, hi, more, fp, root in _sections(batches):
        yield from _edges(joined(rest, lo, hi, more, root, whole), sets)
        found = [np.concatenate(c) for c in zip(*variants(rest, lo, hi, root, most, NEIGHBOURS), strict=True)]
        if not found or not len(found[0]):
            continue
        a, b = np.maximum(fp[found[0]], fp[found[1]]), np.minimum(fp[found[0]], fp[found[1]])
        order = np.lexsort((found[2], a))
        a, b, bits = a[order], b[order], found[2][order]
        start = np.r_[0, np.flatnonzero(np.diff(a)) + 1]
        some = np.arange(len(a)) - np.repeat(start, np.diff(np.r_[start, len(a)])) < NEIGHBOURS
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in (a, b, bits)], ["a", "b", "bits"])


def _together(batches: Iterator[pa.RecordBatch], whole: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """What holds together of different roots: (a, b, null)."""
    sets = Sets()
    for rest, lo, hi, more, _, root in _sections(batches):
        if (root != root[0]).any():
            yield from _edges(joined(rest, lo, hi, more, root, whole), sets)


def shared(sets: list[np.ndarray], root: np.ndarray) -> np.ndarray:
    """Of each set: its members that a set of another root has too. No two sets of different roots have more in common."""
    size = [len(s) for s in sets]
    names, at = np.unique(root, return_inverse=True)
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(at, size)
    low, high = np.full(member.max() + 1, len(names)), np.full(member.max() + 1, -1)
    np.minimum.at(low, member, of)
    np.maximum.at(high, member, of)
    return np.add.reduceat((low != high)[member].astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])


def settle(fp: list[int], root: list[int], bits: list[bytes], sets: list[np.ndarray], similarity: tuple[int, int], differ: tuple[float, float]) -> list[tuple[int, int]]:
    """Links between members of different roots, the likeliest first: as many as join what can be joined."""
    groups, links, width = Sets(), [], min(map(len, bits))
    words = np.stack([np.frombuffer(x, np.uint64, width // 8) for x in bits])
    size, names, (part, whole) = np.array([len(s) for s in sets]), np.array(root), similarity
    common = shared(sets, names)
    few = size <= FEW
    for i in range(len(fp) - 1):
        between = np.bitwise_count(words[i + 1 :] ^ words[i]).sum(1, dtype=np.int64)
        most = np.where(few[i] & few[i + 1 :], furthest(differ[1], 8 * width), furthest(differ[0], 8 * width))
        sizes = np.minimum(common[i], common[i + 1 :]) * (part + whole) >= (size[i] + size[i + 1 :]) * part
        found = np.flatnonzero((between <= most) & sizes & (names[i + 1 :] != names[i]))
        for j in (found[np.argsort(between[found], kind="stable")] + i + 1).tolist():
            if groups.root(root[i]) != groups.root(root[j]) and alike(sets[i], sets[j], similarity):
                groups.join(root[i], root[j])
                links.append((fp[i], fp[j]))
    return links


def _settled(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int], differ: tuple[float, float]) -> Iterator[pa.RecordBatch]:
    """Rows (region, fp, root, bits, set) sorted by region to links (a, b)."""
    for _, held in _by_region(batches):
        fp, root, bits, sets = zip(*held, strict=True)
        links = settle(fp, root, bits, [np.frombuffer(s, np.uint64) for s in sets], similarity, differ)
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY,
    exact: int | None = None, large: int = LARGE, alike_empty: bool = False,
) -> DataFrame:
    """Groups documents that are linked by a Jaccard similarity of ``similarity`` or more of their sets of shingles.

    Returns id_col, n_shingles, component_id, kept, as forest.near_duplicates does, with the same handling of nulls, empty and
    short texts and repeated rows. Equal sets are one row of the segments. Similarities are taken on full sets.

    Each segment of the fingerprint goes as one row to the task of its number and first ``exact`` bits (by default as many as
    make that some 2 ** 14 texts, whatever their number). Of its other REST bits one at a time is deleted there, equal variants
    meet, and pairs are held together whose SKETCH further bits agree: a task gives out fewer of them than it has texts. In
    the first segments each text is compared with those beside it, and the nearest are verified, so that large groups
    of near copies are joined early; in all others, what isn't held together yet. What is held together is a region, whose members
    of different groups one task compares by bits and then by sets, or, in slices of ``large`` texts, a task for each two slices.
    """
    n = partitions(docs)
    if exact is None:
        exact = max(2, math.ceil(math.log2(max(2, docs.count()))) - REST - 2)
    differ = most_differing(similarity)
    counts = tuple(segments(p, exact) for p in differ)
    bits, few_bits = (SKETCH + c * (exact + REST) for c in counts)
    most, whole = (tuple(furthest(p, b) for p in differ) for b in (128, SKETCH))
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    d = d.mapInArrow(partial(_sketched, words=words, bits=bits, few_bits=few_bits), f"id {id_type}, fp bigint, n bigint, bits binary, text string")
    d = written(d.withColumn("row", F.monotonically_increasing_id()), "wide")
    distinct = d.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("bits").alias("bits"), F.min("row").alias("row"))
    distinct = written(distinct, "wide-distinct")

    def texts(fps: DataFrame) -> DataFrame:
        """One row of each, and no copies of it: only texts that are asked for move."""
        asked = written(distinct.select("fp", "row").join(fps, "fp", "left_semi").select("row"), "wide-asked")
        return filtered(d.select("row", "fp", "n", "text"), asked, "row").join(asked, "row", "left_semi").select("fp", "n", "text")

    def sets(fps: DataFrame) -> DataFrame:
        return written(texts(fps).select("fp", "text").mapInArrow(partial(_sets, words=words), "fp bigint, set binary"), "wide-sets", "uncompressed")

    def dealt(rows: DataFrame, counts: tuple[int, int], start: int = 0) -> DataFrame:
        schema = "key bigint, rest bigint, lo bigint, hi bigint, more bigint, fp bigint, root bigint"
        return rows.select("fp", "n", "bits", "root").mapInArrow(partial(_segmented, exact=exact, counts=counts, start=start), schema).repartition(n, "key").sortWithinPartitions("key")

    first = dealt(distinct.withColumn("root", F.col("fp")), tuple(min(FIRST_SEGMENTS, c) for c in counts))
    first = written(first.mapInArrow(partial(_beside, most=most, whole=whole), "a bigint, b bigint, bits bigint"), "wide-first")
    near = first.where("bits is not null").groupBy("a").agg(F.collect_set(F.struct("bits", "b")).alias("near"))
    pairs = written(near.select("a", F.explode(F.transform(F.slice(F.sort_array("near"), 1, NEIGHBOURS), lambda x: x["b"])).alias("b")), "wide-pairs")
    own = sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    both = pairs.join(own.select(F.col("fp").alias("a"), F.col("set").alias("s")), "a").join(own.select(F.col("fp").alias("b"), F.col("set").alias("t")), "b")
    links = written(both.select("a", "b", "s", "t").mapInArrow(partial(_near, similarity=similarity), "a bigint, b bigint"), "wide-links")

    roots = stars(links, "wide-stars").select(F.col("node").alias("fp"), "root")
    grouped = written(distinct.join(roots, "fp", "left").select("fp", "n", "bits", F.coalesce("root", "fp").alias("root")), "wide-grouped")
    edges = first.where("bits is null").select("a", "b")
    held = stars(edges, "wide-held").select(F.col("node").alias("fp"), F.col("root").alias("region"))
    apart = distinct.join(held, "fp", "left").select("fp", "n", "bits", F.coalesce("region", "fp").alias("root"))
    others = dealt(apart, counts, FIRST_SEGMENTS).mapInArrow(partial(_together, whole=whole), "a bigint, b bigint, bits bigint")
    edges = edges.unionByName(written(others.select("a", "b"), "wide-others"))

    held = stars(edges, "wide-held").select(F.col("node").alias("fp"), F.col("root").alias("region"))
    held = held.unionByName(held.select(F.col("region").alias("fp"), "region").distinct())
    members = written(grouped.select("fp", "n", "root").join(held, "fp"), "wide-members")
    regions = members.groupBy("region").agg(F.count("*").alias("copies"), F.sum("n").alias("all"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    slices = F.ceil(F.greatest(F.col("copies") / large, F.when(F.col("copies") > 2, F.col("all") / LARGE_SHINGLES).otherwise(0))).cast("int")
    regions = written(regions.select("region", "copies", slices.alias("slices")), "wide-regions")
    members = join_copies(members, regions, "region").withColumn("__s", F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")).withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    members = members.select(F.concat_ws("-", "region", F.least("__s", "__t"), F.greatest("__s", "__t")).alias("region"), "fp", "root")
    own = sets(members.select("fp").distinct()).join(grouped.select("fp", "bits"), "fp")
    held = members.join(own, "fp").select("region", "fp", "root", "bits", "set").repartition(n, "region").sortWithinPartitions("region")
    links = links.unionByName(written(held.mapInArrow(partial(_settled, similarity=similarity, differ=differ), "a bigint, b bigint"), "wide-links"))
    return named_groups(d, distinct, links, id_col, alike_empty)
