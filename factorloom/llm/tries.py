"""The prefix trie of conversations by an external merge sort that knows what neighbours share.

A turn is a 16-byte digest. Each range of sequences is cut into sorted runs, which are written to the shared
folder with the number of turns that each sequence shares with the one before. A loser tree merges a range's
runs, comparing from the first turn that isn't known to be shared; merged neighbours open and close the nodes
of a path, and closed nodes are given out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .blocks import pack_many, unpack_many
from .common import join_copies, partitions, written

#: Turns to a sorted run, and to a block of it.
RUN_TURNS, BLOCK_TURNS = 1 << 17, 1 << 12
#: Closed children that wait for the smallest id of an open node; more are given out and joined to it later.
WAITING = 10_000
#: Bytes of ids that a node holds; more are given out in pieces and hashed later.
PIECE = 1 << 16
#: Original turns of the earlier conversation that a rebuilt one may begin with, at most.
MOST_HEAD = 8

_NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
_PATH = [("hash", pa.binary()), *((c, pa.int64()) for c in ("n", "conv", "bytes", "children", "leaves", "saved"))]
_OUT = pa.schema([
    ("kind", pa.int32()), ("part", pa.int32()), ("serial", pa.int64()), *((c, pa.int64()) for c in _NODE), ("ends_sha256", pa.string()),
    ("hash", pa.binary()), ("parent", pa.binary()), ("piece", pa.binary()), ("path", pa.list_(pa.struct(_PATH))),
])
_OUT_DDL = (
    "kind int, part int, serial bigint, " + ", ".join(f"{c} bigint" for c in _NODE) + ", ends_sha256 string, hash binary, parent binary, piece binary, "
    "path array<struct<hash: binary, n: bigint, conv: bigint, bytes: bigint, children: bigint, leaves: bigint, saved: bigint>>"
)
#: Kinds of rows: a node, a path at a range's seam, a piece of ids.
_IS_NODE, _IS_PATH, _IS_PIECE = range(3)


def sequences(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, and its turns in order (null first; ties by role, then text): their digests, and bytes of text.

    A digest is of role and text together, null counting as empty. Rows without an id go; repeated rows are turns
    of their own. Texts count whole, whatever their length: a conversation's rows are sorted with spilling, and its
    digests then fit a task. An empty table gives an empty result; other columns are not read, whatever their names.
    """
    t = turns.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    t = t.select("conv_id", F.struct(place.alias("place"), digest.alias("digest"), F.octet_length("text").cast("bigint").alias("bytes")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))
    return t.groupBy("conv_id").agg(ordered.alias("t")).select("conv_id", F.col("t.digest").alias("digests"), F.col("t.bytes").alias("bytes"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Sequences that begin with another's: conversation c takes the first h turns of conversation c - c % 5
    (all if fewer, none if there is no such), then its own after its first h; h = crc32 of c in decimal, % 9."""
    s = written(sequences, "trie-sequences")
    head = s.where("conv_id % 5 = 0").select(F.col("conv_id").alias("__base"), *(F.slice(c, 1, MOST_HEAD).alias(f"__{c}") for c in ("digests", "bytes")))
    s = s.withColumns({"__base": F.col("conv_id") - F.col("conv_id") % 5, "__h": (F.crc32(F.col("conv_id").cast("string")) % (MOST_HEAD + 1)).cast("int")})
    own = lambda c: F.slice(c, F.col("__h") + 1, F.greatest(F.size(c) - F.col("__h"), F.lit(0)))
    both = lambda c: F.when(F.col(f"__{c}").isNull(), own(c)).otherwise(F.concat(F.slice(f"__{c}", F.lit(1), F.col("__h")), own(c)))
    return s.join(head, "__base", "left").select("conv_id", both("digests").alias("digests"), both("bytes").alias("bytes"))


# runs: an element is [turns shared with the one before, digests, conv_id, bytes]


def shared(a: list[bytes], b: list[bytes], known: int = 0) -> int:
    """How many turns both begin with, of which ``known`` are known."""
    n = min(len(a), len(b))
    while known < n and a[known] == b[known]:
        known += 1
    return known


def sorted_run(rows: list[tuple[list[bytes], int, list[int]]]) -> list[list]:
    """Rows (digests, conv_id, bytes) in order, each with what it shares with the one before."""
    rows.sort(key=lambda r: r[:2])
    before, out = [], []
    for digests, conv, sizes in rows:
        out.append([shared(before, digests), digests, conv, sizes])
        before = digests
    return out


def pack_block(elements: list[list]) -> bytes:
    """Elements of a run; but for the first, only turns that aren't those of the element before."""
    new = [0 if i == 0 else e[0] for i, e in enumerate(elements)]
    turns = [len(e[1]) for e in elements]
    sizes = [s for e, n in zip(elements, new, strict=True) for s in e[3][n:]]
    ids = np.array([e[2] for e in elements], np.int64).view(np.uint64)
    return pack_many(np.array([e[0] for e in elements]), np.array(turns), np.array(sizes), ids, b"".join(d for e, n in zip(elements, new, strict=True) for d in e[1][n:]))


def unpack_block(data: bytes) -> Iterator[list]:
    lcps, turns, sizes, ids, raw = unpack_many(data, (4,))
    digests, own, at = [], [], 0
    for i, (lcp, n, conv) in enumerate(zip(lcps.tolist(), turns.tolist(), ids.tolist(), strict=True)):
        keep = 0 if i == 0 else lcp
        more = n - keep
        digests = digests[:keep] + [raw[16 * k : 16 * k + 16] for k in range(at, at + more)]
        own = own[:keep] + sizes[at : at + more].tolist()
        at += more
        yield [lcp, digests, conv, own]


def _runs(batches: Iterator[pa.RecordBatch], run_turns: int, block_turns: int) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, digests, bytes) of a range to blocks of its runs: part, run, the block's first element, data."""
    context, rows, held, run = TaskContext.get(), [], 0, 0
    part = context.partitionId() if context else 0

    def close() -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for e in [*sorted_run(rows), None]:
            if e is None or size >= block_turns:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([run], pa.int32()), pa.array([block[0][1]], pa.list_(pa.binary())), pa.array([block[0][2]]), pa.array([pack_block(block)], pa.binary())], ["part", "run", "digests", "conv_id", "data"])
                block, size = [], 0
            block.append(e)
            size += len(e[1]) + 1 if e else 0

    for b in batches:
        for conv, digests, sizes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            rows.append((digests.as_py(), conv, sizes.as_py()))
            held += len(rows[-1][0]) + 1
            if held >= run_turns:
                yield from close()
                rows, held, run = [], 0, run + 1
    if rows:
        yield from close()


class LoserTree:
    """The least of several heads. A head's first item is the number of turns that it shares with the element
    given out last, or, once beaten, with the head that beat it; only turns beyond that are compared."""

    def __init__(self, heads: list[list | None]) -> None:
        self.size = 1 << max(0, len(heads) - 1).bit_length()
        self.heads = heads + [None] * (self.size - len(heads))
        self.beaten = [0] * max(1, self.size)
        self.first = self._play(1)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        first, self.beaten[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return first

    def _match(self, a: int, b: int) -> tuple[int, int]:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if x[0] != y[0]:
            return (a, b) if x[0] > y[0] else (b, a)
        d = shared(x[1], y[1], x[0])
        least = min(len(x[1]), len(y[1]))
        if (x[1][d] < y[1][d]) if d < least else ((len(x[1]), x[2]) < (len(y[1]), y[2])):
            y[0] = d
            return a, b
        x[0] = d
        return b, a

    def replace(self, head: list | None) -> None:
        """The first head's successor in its run, or None at the run's end."""
        at = self.first
        self.heads[at] = head
        node = (at + self.size) // 2
        while node:
            at, self.beaten[node] = self._match(at, self.beaten[node])
            node //= 2
        self.first = at


def merged(blocks: Iterable[tuple[int, list[bytes], int, bytes]]) -> Iterator[list]:
    """From (run, first digests, first conv_id, data) in order of the first elements: all elements in order, each
    with what it shares with the one before.

    A block is opened when its first element's turn has come, so at most one block of each run is open.
    """
    blocks, runs, slots = iter(blocks), [], {}
    coming = next(blocks, None)
    heads: list[list | None] = []
    last: list[bytes] = []

    def tree() -> LoserTree:
        for h in heads:
            if h is not None:
                h[0] = shared(last, h[1])
        waiting = None if coming is None else [shared(last, coming[1]), coming[1], coming[2], None]
        return LoserTree([waiting, *heads])

    order = tree()
    while (top := order.heads[order.first]) is not None:
        if order.first == 0:  # the next block begins here
            run, _, _, data = coming
            coming = next(blocks, None)
            slot = slots.setdefault(run, len(runs))
            if slot == len(runs):
                runs.append(None)
                heads.append(None)
            runs[slot] = unpack_block(data)
            heads = order.heads[1 : len(runs) + 1] + [None] * (len(runs) - len(order.heads) + 1)
            element = next(runs[slot])
            element[0], last = top[0], element[1]
            yield element
            heads[slot] = next(runs[slot], None)
            order = tree()
        else:
            last = top[1]
            out = list(top)
            order.replace(next(runs[order.first - 1], None))
            yield out


class _Open:
    """A node whose members are still coming; its counts are of what has closed below it and ends in it."""

    __slots__ = ("depth", "bytes", "seam", "n", "conv", "children", "leaves", "saved", "waiting", "flushed", "ids", "pieces")

    def __init__(self, depth: int, size: int, seam: bool) -> None:
        self.depth, self.bytes, self.seam = depth, size, seam
        self.n = self.children = self.leaves = self.saved = self.pieces = 0
        self.conv, self.waiting, self.flushed, self.ids = None, [], False, bytearray()

    def member(self, conv: int | None, n: int = 1) -> None:
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv


def path_hashes(digests: list[bytes]) -> list[bytes]:
    """Of each prefix of a sequence, from none to all of its turns."""
    h, out = md5(), [md5().digest()]
    for d in digests:
        h.update(d)
        out.append(h.digest())
    return out


class _Nodes:
    """The open path of one range; rows of closed nodes, seams and pieces gather in ``rows``."""

    def __init__(self, part: int, waiting: int, piece: int) -> None:
        self.part, self.most, self.piece = part, waiting, piece
        self.rows: list[dict] = []
        self.stack: list[_Open] = []
        self.digests: list[bytes] = []
        self.seam: list[dict | None] = []

    def _hash(self, depth: int) -> bytes:
        return md5(b"".join(self.digests[:depth])).digest()

    def _give_ids(self, v: _Open) -> None:
        if v.ids:
            self.rows.append({"kind": _IS_PIECE, "part": self.part, "serial": v.pieces, "hash": self._hash(v.depth), "piece": bytes(v.ids)})
            v.ids, v.pieces = bytearray(), v.pieces + 1

    def _give_children(self, v: _Open) -> None:
        if v.waiting:
            parent = self._hash(v.depth)
            self.rows += [r | {"parent": parent} for r in v.waiting]
            v.waiting, v.flushed = [], True

    def add(self, lcp: int, digests: list[bytes], conv: int, sizes: list[int]) -> None:
        seam = not self.stack
        while len(self.stack) > lcp + 1:
            self._close(self.stack.pop())
        if seam:
            self.stack.append(_Open(0, 0, True))
        for d in range(len(self.stack), len(digests) + 1):
            self.stack.append(_Open(d, sizes[d - 1], seam))
        self.digests = digests
        last = self.stack[-1]
        last.member(conv)
        last.ids += b",%d" % conv if last.ids or last.pieces else b"%d" % conv
        if len(last.ids) >= self.piece:
            self._give_ids(last)

    def _partial(self, v: _Open) -> dict:
        """What a node at a seam has here; its pieces and children are given out."""
        self._give_ids(v)
        self._give_children(v)
        return {"hash": self._hash(v.depth), "n": v.n, "conv": v.conv, "bytes": v.bytes, "children": v.children, "leaves": v.leaves, "saved": v.saved}

    def _close(self, v: _Open) -> None:
        if v.seam:
            self.seam.append(self._partial(v))
            return
        parent = self.stack[-1]
        v.leaves = v.leaves or 1
        v.saved += (v.n - 1) * v.bytes
        row = {"kind": _IS_NODE, "conv_id": v.conv, "depth": v.depth, "n_convs": v.n, "n_children": v.children, "n_leaves": v.leaves, "saved_tokens": v.saved}
        if v.pieces:
            self._give_ids(v)
        else:
            row["ends_sha256"] = sha256(v.ids).hexdigest()
        for r in v.waiting:
            self.rows.append(r | {"parent_conv_id": v.conv})
        if v.pieces or v.flushed:
            row["hash"] = self._hash(v.depth)
        parent.member(v.conv, v.n)
        parent.children += 1
        parent.leaves += v.leaves
        parent.saved += v.saved
        parent.waiting.append(row)
        if len(parent.waiting) >= self.most:
            self._give_children(parent)

    def end(self) -> None:
        """The first and the last path go as they are: other ranges may have more of their nodes."""
        if not self.stack:
            return
        last = []
        while self.stack:
            v = self.stack.pop()
            own = self._partial(v)
            if v.seam:
                self.seam.append(own)
                own = own | {"n": 0, "conv": None, "children": 0, "leaves": 0, "saved": 0}
            last.append(own)
        for serial, path in enumerate((self.seam, last)):
            self.rows.append({"kind": _IS_PATH, "part": self.part, "serial": serial, "path": path[::-1]})


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_OUT)


def _merged(batches: Iterator[pa.RecordBatch], waiting: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Blocks (part, run, digests, conv_id, data) of one range, in order of their first elements, to rows of _OUT."""
    nodes = None

    def blocks() -> Iterator[tuple]:
        nonlocal nodes
        for b in batches:
            for at in range(len(b)):
                part, run, digests, conv, data = (b.column(c)[at].as_py() for c in range(5))
                nodes = nodes or _Nodes(part, waiting, piece)
                yield run, digests, conv, data

    for lcp, digests, conv, sizes in merged(blocks()):
        nodes.add(lcp, digests, conv, sizes)
        if len(nodes.rows) >= 10_000:
            yield _batch(nodes.rows)
            nodes.rows = []
    if nodes is not None:
        nodes.end()
        yield _batch(nodes.rows)


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths at the ranges' seams, in order, to their nodes: the open-path stack once more, over two paths a range."""
    stack: list[tuple[bytes, _Open]] = []
    rows: list[dict] = []

    def close() -> None:
        own, v = stack.pop()
        v.leaves = v.leaves or 1
        v.saved += (v.n - 1) * v.bytes
        rows.append({"kind": _IS_NODE, "conv_id": v.conv, "depth": v.depth, "n_convs": v.n, "n_children": v.children, "n_leaves": v.leaves, "saved_tokens": v.saved, "hash": own, "parent": stack[-1][0] if stack else None})
        if stack:
            up = stack[-1][1]
            up.member(v.conv, v.n)
            up.children += 1
            up.leaves += v.leaves
            up.saved += v.saved

    for b in batches:
        for path in b.column(0).to_pylist():
            same = 0
            while same < min(len(path), len(stack)) and stack[same][0] == path[same]["hash"]:
                same += 1
            while len(stack) > same:
                close()
            for d, x in enumerate(path):
                if d == len(stack):
                    stack.append((x["hash"], _Open(d, x["bytes"], True)))
                v = stack[d][1]
                v.member(x["conv"], x["n"])
                v.children += x["children"]
                v.leaves += x["leaves"]
                v.saved += x["saved"]
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows = []
    while stack:
        close()
    if rows:
        yield _batch(rows)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces (hash, piece) in order to the SHA-256 of each node's ids, joined by commas."""
    own, state, rows = None, None, []
    for b in batches:
        for h, piece in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            piece = piece.as_py().lstrip(b",")
            if h != own:
                if state:
                    rows.append((own, state.hexdigest()))
                own, state = h, sha256(piece)
            else:
                state.update(b"," + piece)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["hash", "ends"])
            rows = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([state.hexdigest()])], ["hash", "ends"])


def prefix_trie(sequences: DataFrame, run_turns: int = RUN_TURNS, block_turns: int = BLOCK_TURNS, waiting: int = WAITING, piece: int = PIECE) -> DataFrame:
    """Nodes of the trie of ``sequences`` (conv_id, digests, bytes; conv_id is unique): a row for each distinct
    sequence of first turns, from the root of none.

    conv_id is the smallest member, parent_conv_id the parent's (root: null), n_convs counts members,
    n_children and n_leaves children and childless nodes below (a childless node is its own leaf), saved_tokens
    sums (n_convs - 1) * bytes of the last turn over the subtree, ends_sha256 is of the ids of the members that
    end here, ascending and joined by commas.

    Ranges are by (sequence, id), so that copies of one conversation may lie in several. A range's runs are written to the
    shared folder and merged block by block: a task holds a run while it sorts, then a block of each run and
    the open path. Nodes on a range's first and last path may have members in its neighbours; these paths, two
    a range, meet in one task that streams over them with a path as its memory. A node with more ids, or more
    children, than a task should hold gives them out, and they meet it by a join. One conversation's digests
    (16 bytes a turn) fit a task; its text need not.

    Sequences without turns end in the root. No sequences give no rows, not even a root.
    """
    sequences = written(sequences.select("conv_id", "digests", "bytes"), "trie-rebuilt")
    n = partitions(sequences)
    ranges = sequences.repartitionByRange(n, "digests", "conv_id")
    runs = written(ranges.mapInArrow(partial(_runs, run_turns=run_turns, block_turns=block_turns), "part int, run int, digests array<binary>, conv_id bigint, data binary"), "trie-runs", "uncompressed")
    parts = max(n, (runs.agg(F.max("part")).first()[0] or 0) + 1)
    dealt = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "digests", "conv_id")
    out = written(dealt.mapInArrow(partial(_merged, waiting=waiting, piece=piece), _OUT_DDL), "trie-nodes")
    seams = out.where(F.col("kind") == _IS_PATH).select("path", "part", "serial").repartition(1).sortWithinPartitions("part", "serial")
    seams = written(seams.select("path").mapInArrow(_seams, _OUT_DDL), "trie-seams")
    pieces = out.where(F.col("kind") == _IS_PIECE).select("hash", "piece", "part", "serial").repartition(n, "hash").sortWithinPartitions("hash", "part", "serial")
    ends = written(pieces.select("hash", "piece").mapInArrow(_hashed, "hash binary, ends string"), "trie-ends")

    names = [*_NODE, "ends_sha256"]
    nodes = out.where(F.col("kind") == _IS_NODE).unionByName(seams)
    settled = nodes.where("hash is null and parent is null").select(*names)
    rest = written(nodes.where("hash is not null or parent is not null").select(*names, "hash", "parent").join(ends, "hash", "left"), "trie-rest")
    rest = rest.withColumn("ends_sha256", F.coalesce("ends_sha256", "ends", F.sha2(F.lit(b""), 256)))
    parents = rest.where("hash is not null").select(F.col("hash").alias("parent"), F.col("conv_id").alias("__parent"), F.col("n_children").alias("copies"))
    named = join_copies(rest.where("parent is not null"), parents, "parent").withColumn("parent_conv_id", F.col("__parent"))
    return settled.unionByName(named.select(*names)).unionByName(rest.where("parent is null").select(*names))
