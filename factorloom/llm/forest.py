"""Near-duplicates by exact Jaccard similarity; candidates are neighbours in an LSH forest of MinHash signatures.

A tree of the forest is an order: texts sorted by a sequence of minima. Texts that share a prefix are a region of
that tree. Neighbours of the longest common prefix are compared first; regions that then still hold several groups
are gone through whole if they are small, and at a greater depth, in as many more orders as that depth needs, if not.
Sets of shingles move only for pairs that a comparison of minima lets through, each in one region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Sets, join_copies, partitions, written
from .simhash import _LOWER, SEED

#: Words to a shingle; linked texts have a Jaccard similarity of at least this fraction.
SHINGLE_WORDS, SIMILARITY = 5, (17, 20)
#: Minima that a region's texts share, from level to level; share of pairs at the similarity that meet in no region.
DEPTHS, MISSED = (6, 12, 24), 1e-7
#: A signature goes on beyond the depth, to tell neighbours apart: so many times the depth.
REACH = 4
#: Orders in which each text is first compared with a neighbour, and of how many of these neighbours, those of the longest common prefixes.
FIRST_ORDERS, NEIGHBOURS = 12, 2
#: A region of more texts, or of more shingles in all, is large.
LARGE, LARGE_SHINGLES = 2048, 1 << 22
#: Standard deviations by which the share of equal minima may fall short of the similarity in a pair that is taken up.
SLACK = 5.3
#: Bits of the filter that keeps texts that aren't asked for out of shuffles: two megabytes, whatever the input.
FILTER_BITS = 1 << 24
#: Shingles permuted at a time.
_CHUNK = 1 << 9


def trees(depth: int, similarity: tuple[int, int] = SIMILARITY, missed: float = MISSED) -> int:
    """Orders in which all but ``missed`` of the pairs at the similarity share a prefix of ``depth`` minima."""
    return math.ceil(math.log(missed) / math.log1p(-((similarity[0] / similarity[1]) ** depth)))


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """The set of a text's shingles as sorted XXH64 (seed 42), of the same words as SimHash takes."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), SEED)], np.uint64)
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1))


def agreement(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Of each of ``some`` (rows of bytes, one for each minimum) with each of ``others``: the share that is equal."""
    out = np.empty((len(some), len(others)), np.float32)
    step = max(1, (1 << 25) // max(1, others.size))
    for at in range(0, len(some), step):
        out[at : at + step] = (some[at : at + step, None, :] == others[None, :, :]).mean(2, dtype=np.float32)
    return out


def ring(h: np.ndarray, n: int, level: int = 0) -> bytes:
    """A byte for the least of ``h`` under each of ``n`` random orders. A tree's signature begins at its own place in the
    ring and goes on into the next tree's."""
    factors = np.random.default_rng([SEED, level]).integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    low = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), _CHUNK):
        np.minimum(low, (factors[:, None] * h[None, at : at + _CHUNK]).min(1), out=low)
    return (((low ^ (low >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def alike(a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> bool:
    """Whether two sets (sorted) have a Jaccard similarity of that fraction or more."""
    part, whole = similarity
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common * whole >= (len(both) - common) * part


def _sketched(batches: Iterator[pa.RecordBatch], words: int, n: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps, sizes, rings = [], [], []
        for text in b.column(1):
            h = shingles(text.as_py(), words)
            fps.append(xxhash.xxh3_64_intdigest(h.tobytes(), SEED))
            sizes.append(len(h))
            rings.append(ring(h, n) if len(h) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(rings, pa.binary()), b.column(1)], ["id", "fp", "n", "ring", "text"])


def _rings(batches: Iterator[pa.RecordBatch], words: int, n: int, level: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([ring(shingles(t.as_py(), words), n, level) for t in b.column(2)], pa.binary())], ["fp", "n", "ring"])


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), words).tobytes() for t in b.column(1)], pa.binary())], ["fp", "set"])


def _neighbours(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (signature, fp) in order to those that share ``least`` bytes with the one before: (a, the one before, bytes shared)."""
    last_sig, last_fp = np.zeros((0, 1), np.uint8), np.zeros(0, np.int64)
    for b in batches:
        if not len(b):
            continue
        sig = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(len(b), -1)
        fp = b.column(1).to_numpy()
        if len(last_fp):
            sig, fp = np.concatenate([last_sig, sig]), np.concatenate([last_fp, fp])
        last_sig, last_fp = sig[-1:], fp[-1:]
        differ = sig[1:] != sig[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), sig.shape[1])
        at = np.flatnonzero(lcp >= least)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (fp[at + 1], fp[at], lcp[at])], ["a", "b", "lcp"])


def _near(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = (np.frombuffer(s.as_py(), np.uint64) for s in b.column(2)), (np.frombuffer(s.as_py(), np.uint64) for s in b.column(3))
        near = pa.array([alike(s, t, similarity) for s, t in zip(*sets, strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], ["a", "b"])


def candidates(root: np.ndarray, rings: np.ndarray, similarity: tuple[int, int], depth: int, tree: int) -> Iterator[tuple[int, list[int]]]:
    """Members of one region that are of different groups and agree in enough minima to be taken up: each with its
    partners, the likeliest first. A pair that shares several regions is taken up in the first of them only, that
    of the least ``tree``. Members of the largest group have no partners of their own.
    """
    names, at, count = np.unique(root, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return
    s, width = similarity[0] / similarity[1], rings.shape[1]
    least = s - SLACK * math.sqrt(s * (1 - s) / width)
    some = np.flatnonzero(at != count.argmax())
    before = rings[:, : tree * depth].reshape(len(rings), tree, depth)
    for lo in range(0, len(some), 256):
        x = some[lo : lo + 256]
        share = agreement(rings[x], rings)
        share[at[x][:, None] == at[None, :]] = -1
        for i, row in zip(x.tolist(), share, strict=True):
            found = np.flatnonzero(row >= least)
            if len(found) and tree:
                found = found[~(before[found] == before[i]).all(2).any(1)]
            if len(found):
                yield i, found[np.argsort(-row[found], kind="stable")].tolist()


def settle(fp: np.ndarray, root: np.ndarray, rings: np.ndarray, sets: list[np.ndarray], similarity: tuple[int, int], depth: int = 1, tree: int = 0) -> list[tuple[int, int]]:
    """Links between the candidates() of one region: as many as join what can be joined."""
    groups, links = Sets(), []
    for i, partners in candidates(root, rings, similarity, depth, tree):
        for j in partners:
            if groups.root(int(root[i])) != groups.root(int(root[j])) and alike(sets[i], sets[j], similarity):
                groups.join(int(root[i]), int(root[j]))
                links.append((int(fp[i]), int(fp[j])))
    return links


def _by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[list]]]:
    """Rows sorted by their first column, as (region, rows of the others)."""
    region, held = None, []
    for b in batches:
        for at in range(len(b)):
            r, *row = (b.column(c)[at].as_py() for c in range(b.num_columns))
            if r != region:
                if held:
                    yield region, held
                region, held = r, []
            held.append(row)
    if held:
        yield region, held


def _open(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (region, fp, root, ring) to those of members that have a candidate: (region, fp, root)."""
    for region, held in _by_region(batches):
        root = np.array([r[1] for r in held])
        own: set[int] = set()
        for i, partners in candidates(root, _stack(held, 2), similarity, depth, int.from_bytes(region[:2], "big")):
            own.add(i)
            own.update(partners)
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([region] * len(own), pa.binary()), *(pa.array([held[i][c] for i in sorted(own)], pa.int64()) for c in (0, 1))], ["region", "fp", "root"])


def _settled(batches: Iterator[pa.RecordBatch], similarity: tuple[int, int], depth: int) -> Iterator[pa.RecordBatch]:
    """Rows (region, fp, root, ring, set) sorted by region to links (a, b)."""
    for region, held in _by_region(batches):
        fp, root = (np.array([r[c] for r in held]) for c in (0, 1))
        links = settle(fp, root, _stack(held, 2), [np.frombuffer(r[3], np.uint64) for r in held], similarity, depth, int.from_bytes(region[:2], "big"))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])


def _stack(held: list[list], column: int) -> np.ndarray:
    return np.stack([np.frombuffer(r[column], np.uint8) for r in held])


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one task to a star for each of its groups: (node, root)."""
    sets = Sets()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sets.join(x, y)
    nodes = list(sets.up)
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([sets.root(x) for x in some], pa.int64())], ["node", "root"])


def stars(links: DataFrame, name: str) -> DataFrame:
    """Connected components of ``links`` (two columns): (node, root), root the smallest node reachable, for all other nodes.

    Each round joins the links that a task holds, then lets each node's roots meet (a root a task, at most) and points
    what hangs below a root at that root's own. A round is one small shuffle and a join that is dealt by size;
    each is written, so no plan grows. Rounds go on until every node has one root that is no node itself.
    """
    state = written(links.mapInArrow(_local, "node bigint, root bigint"), name)
    while True:
        seen = Observation()
        both = state.unionByName(state.select(F.col("root").alias("node"), F.lit(None).cast("bigint").alias("root")))
        met = both.groupBy("node").agg(F.min("root").alias("root"), F.collect_set("root").alias("roots"), F.max(F.col("root").isNull()).alias("is_root")).where("root is not null")
        left = F.count(F.when(F.col("is_root") | (F.size("roots") > 1), 1))
        met = written(met.observe(seen, left.alias("left")), name)
        if not seen.get["left"]:
            return met.select("node", "root")
        hang = met.select("node", "root").unionByName(met.select(F.explode("roots").alias("node"), "root").where("node <> root"))
        ups = met.where("is_root").select(F.col("node").alias("root"), F.col("root").alias("up"))
        state = written(hang.join(ups, "root", "left").select("node", F.coalesce("up", "root").alias("root")).mapInArrow(_local, "node bigint, root bigint"), name)


def filtered(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """``rows`` without most of those whose ``key`` isn't in ``asked``: by a broadcast bitmap of hashes of FILTER_BITS bits.

    No asked row is lost; how many others pass depends on how full the bitmap is.
    """
    bit = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    page, place = F.floor(bit / 32768).cast("int"), F.pmod(bit, F.lit(32768)).cast("int")
    pages = asked.groupBy(page.alias("__page")).agg(F.bitmap_construct_agg(place).alias("__bits"))
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("__page", page).join(F.broadcast(pages), "__page")
    return held.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(place, F.lit(8)))) != 0).select(*rows.columns)


def named_groups(d: DataFrame, distinct: DataFrame, links: DataFrame, id_col: str, alike_empty: bool) -> DataFrame:
    """What near_duplicates() returns, of rows (id, n, fp), their sets (fp, rep, copies) and links between sets."""
    roots = stars(links, "forest-stars")
    in_groups = roots.select(F.col("node").alias("fp"), "root").union(roots.select(F.col("root").alias("fp"), "root")).distinct()
    reps = written(in_groups.join(distinct.select("fp", "rep"), "fp"), "forest-reps")
    least = reps.groupBy("root").agg(F.min("rep").alias("component"))
    in_groups = reps.join(least, "root").select("fp", "component")
    named = written(distinct.select("fp", "rep", "copies").join(in_groups, "fp", "left").select("fp", "copies", F.coalesce("component", "rep").alias("component_id")), "forest-named")
    out = join_copies(d.where("n > 0").select("id", "n", "fp"), named, "fp").select("id", "n", "component_id")
    none = d.where("n = 0").select("id", "n")
    if alike_empty:
        none = none.crossJoin(F.broadcast(none.agg(F.min("id").alias("component_id"))))  # one row
    else:
        none = none.withColumn("component_id", F.col("id"))
    out = out.unionByName(none)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, similarity: tuple[int, int] = SIMILARITY,
    depths: tuple[int, ...] = DEPTHS, large: int = LARGE, large_shingles: int = LARGE_SHINGLES, alike_empty: bool = False,
) -> DataFrame:
    """Groups documents that are linked by a Jaccard similarity of ``similarity`` or more of their sets of shingles.

    Returns id_col, n_shingles (size of the set), component_id (the smallest id reachable through links), kept
    (whether that is the row's own). Equal sets are one member of the forest. Similarities are taken on full sets.

    In each of the first orders, texts are sorted by signature over all partitions (ranges of signatures, so that no
    region has to fit a task), and each is compared with NEIGHBOURS of those before it, nearest in prefix. Then regions
    (a common prefix of the level's depth, in any order) that still hold several groups are settled: small ones by
    one task each, which looks at the minima of members of different groups, and then at the sets of those that are
    likely; members of large ones go on to the next level, whose deeper prefixes split them, with orders added
    so that again all but MISSED of the pairs at the similarity meet. Regions that are large at the last depth are cut
    into slices, and each two slices are a task's: all pairs that can matter are looked at there, by tasks of twice
    ``large`` texts, and only links are given out.

    A text of fewer words than a shingle is one shingle as a whole. Null texts, and those without words, have an
    empty set and are linked with nothing (with ``alike_empty``: with each other). Rows with a null id keep their row and take part; if no linked row
    has an id, component_id is null. Repeated rows stay. Texts count whole, whatever their length. An empty
    table gives an empty result; other columns are not read, whatever their names.
    """
    n = partitions(docs)
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = d.schema["id"].dataType.simpleString()
    width = depths[0] * trees(depths[0], similarity)
    d = d.mapInArrow(partial(_sketched, words=words, n=width), f"id {id_type}, fp bigint, n bigint, ring binary, text string")
    d = written(d.withColumn("row", F.monotonically_increasing_id()), "forest")
    distinct = d.where("n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("ring").alias("ring"), F.min("row").alias("row"))
    distinct = written(distinct, "forest-distinct")

    def texts(fps: DataFrame) -> DataFrame:
        """One row of each, and no copies of it: only texts that are asked for move."""
        asked = written(distinct.select("fp", "row").join(fps, "fp", "left_semi").select("row"), "forest-asked")
        return filtered(d.select("row", "fp", "n", "text"), asked, "row").join(asked, "row", "left_semi").select("fp", "n", "text")

    def sets(fps: DataFrame) -> DataFrame:
        return written(texts(fps).select("fp", "text").mapInArrow(partial(_sets, words=words), "fp bigint, set binary"), "forest-sets", "uncompressed")

    rings, links = distinct.select("fp", "n", "ring"), d.sparkSession.createDataFrame([], "a bigint, b bigint")
    for level, depth in enumerate(depths):
        signed = _signatures(rings, depth, min(FIRST_ORDERS, trees(depth, similarity)))
        order = signed.select("signature", "fp").repartitionByRange(n, "signature", "fp").sortWithinPartitions("signature", "fp")
        near = order.mapInArrow(partial(_neighbours, least=depth + 2), "a bigint, b bigint, lcp bigint").groupBy("a").agg(F.collect_set(F.struct(-F.col("lcp"), "b")).alias("near"))
        pairs = written(near.select("a", F.explode(F.array_distinct(F.transform(F.slice(F.sort_array("near"), 1, NEIGHBOURS), lambda x: x["b"]))).alias("b")), "forest-pairs")
        own = sets(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
        both = pairs.join(own.select(F.col("fp").alias("a"), F.col("set").alias("s")), "a").join(own.select(F.col("fp").alias("b"), F.col("set").alias("t")), "b")
        links = links.unionByName(written(both.select("a", "b", "s", "t").mapInArrow(partial(_near, similarity=similarity), "a bigint, b bigint"), "forest-links"))

        roots = stars(links, "forest-stars").select(F.col("node").alias("fp"), "root")
        grouped = written(rings.join(roots, "fp", "left").select("fp", "n", "ring", F.coalesce("root", "fp").alias("root")), "forest-grouped")
        signed = _signatures(grouped, depth, trees(depth, similarity)).withColumn("region", F.substring("signature", 1, depth + 2)).drop("signature")
        regions = signed.groupBy("region").agg(F.count("*").alias("copies"), F.sum("n").alias("all"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        slices = F.ceil(F.greatest(F.col("copies") / large, F.when(F.col("copies") > 2, F.col("all") / large_shingles).otherwise(0))).cast("int")
        regions = written(regions.where("lo <> hi").select("region", "copies", slices.alias("slices")), "forest-regions")
        last = level + 1 == len(depths)
        members = join_copies(signed, regions if last else regions.where("slices = 1"), "region")
        if last:
            own_slice = F.pmod(F.xxhash64("fp"), F.col("slices")).cast("int")
            members = members.withColumn("__s", own_slice).withColumn("__t", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
            members = members.withColumn("region", F.concat("region", F.encode(F.concat_ws("-", F.least("__s", "__t"), F.greatest("__s", "__t")), "UTF-8")))
        held = members.select("region", "fp", "root").join(grouped.select("fp", "ring"), "fp").select("region", "fp", "root", "ring").repartition(n, "region").sortWithinPartitions("region")
        members = written(held.mapInArrow(partial(_open, similarity=similarity, depth=depth), "region binary, fp bigint, root bigint"), "forest-members")
        own = sets(members.select("fp").distinct()).join(grouped.select("fp", "ring"), "fp")
        held = members.join(own, "fp").select("region", "fp", "root", "ring", "set").repartition(n, "region").sortWithinPartitions("region")
        links = links.unionByName(written(held.mapInArrow(partial(_settled, similarity=similarity, depth=depth), "a bigint, b bigint"), "forest-links"))
        open_ = None if last else regions.where("slices > 1").select("region", "copies")
        if open_ is None or open_.isEmpty():
            break
        fps = join_copies(signed.select("region", "fp"), open_, "region").select("fp").distinct()
        width = depths[level + 1] * trees(depths[level + 1], similarity)
        rings = written(texts(fps).mapInArrow(partial(_rings, words=words, n=width, level=level + 1), "fp bigint, n bigint, ring binary"), "forest-rings")

    return named_groups(d, distinct, links, id_col, alike_empty)


def _signatures(rings: DataFrame, depth: int, orders: int) -> DataFrame:
    """A row for each order: ``signature`` is the order's number in two bytes, then minima from its place in the ring on."""
    reach = min(REACH * depth, depth * orders)
    tree = F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("__tree")
    around = F.concat("ring", F.substring("ring", 1, reach))
    number = F.unhex(F.lpad(F.hex("__tree"), 4, "0"))
    return rings.select("*", tree).select(*rings.columns, F.concat(number, F.substring(around, F.col("__tree") * depth + 1, F.lit(reach))).alias("signature")).drop("ring")
