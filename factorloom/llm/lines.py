"""Line dedup by a segment-partition edit join: repeated lines, exact or within a few edits, go."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import partial
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import blocks
from .common import by_part, grouped, partitions, written

#: Most edits (insert, delete, substitute a code point) between lines that count as repeated.
MOST_EDITS = 2
#: Shorter lines (code points) go only if they repeat an earlier one exactly.
LEAST_CHARS = 15
#: In groups of more lines, counts of code points (in so many classes) are compared before lines; groups of more
#: pairs are cut by a further segment, so many times at most.
_LARGE, _BAG, _PAIRS, _CUTS = 48, 32, 1 << 22, 2


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits between a and b, or most + 1 if there are more.

    Common ends are cut off; the rest goes through the banded bit-parallel recurrence.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) > len(b):
        a, b = b, a
    at, n = 0, len(a)
    step = 64
    while at < n and step:
        if a[at : at + step] == b[at : at + step] and at + step <= n:
            at += step
        else:
            step //= 2
    a, b = a[at:], b[at:]
    end, n, step = 0, len(a), 64
    while end < n and step:
        if end + step <= n and a[len(a) - end - step : len(a) - end] == b[len(b) - end - step : len(b) - end]:
            end += step
        else:
            step //= 2
    a, b = a[: len(a) - end], b[: len(b) - end]
    m = len(a)
    if not m:
        return min(len(b), most + 1)
    if most < m and most < 31:
        return _banded(a, b, most)
    row = list(range(m + 1))
    for j, c in enumerate(b, 1):
        old, row[0] = row[0], j
        for i in range(1, m + 1):
            old, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, old + (a[i - 1] != c))
    return min(row[m], most + 1)


_WORD = (1 << 64) - 1


def _banded(a: str, b: str, most: int) -> int:
    """Edit distance within a band of diagonals held in one 64-bit word that moves down a row a column
    (Hyyroe 2003): first along the band's lowest diagonal, then along the last row."""
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        masks[c] |= 1 << i
    plus, minus, score = (_WORD << (63 - most)) & _WORD, 0, most
    limit = 2 * most + len(b) - len(a)
    start, row = most - 63, 1 << 62
    for j, c in enumerate(b):
        x = masks.get(c, 0)
        x = (x >> start if start >= 0 else x << -start) & _WORD
        d = ((((x & plus) + plus) ^ plus) | x | minus) & _WORD
        up, down = (minus | ~(d | plus)) & _WORD, d & plus
        if j < len(a) - most:
            score += not d >> 63
        else:
            score += bool(up & row) - bool(down & row)
            row >>= 1
        if score > limit:
            return most + 1
        shifted = d >> 1
        plus, minus = (down | ~(shifted | up)) & _WORD, shifted & up
        start += 1
    return min(score, most + 1)


def _segments(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of the segments of a line of ``n``: even, the longer ones last."""
    short, extra = divmod(n, parts)
    sizes = [short + (i >= parts - extra) for i in range(parts)]
    return [(sum(sizes[:i]), s) for i, s in enumerate(sizes)]


def probes(n: int, most: int) -> list[tuple[int, int, int, int]]:
    """Substrings of a line of ``n`` that stand for it: (indexed length, segment, start, size).

    Own segments are the index; for each length from n - most to n, the substrings that an equal
    segment of a line of that length may match, by its place seen from both ends.
    """
    out = []
    for length in range(max(n - most, 0), n + 1):
        delta = n - length
        for i, (p, size) in enumerate(_segments(length, most + 1)):
            if not size:
                continue
            lo = max(0, p - i, p + delta - (most - i))
            hi = min(n - size, p + i, p + delta + (most - i))
            out += [(length, i, s, size) for s in range(lo, hi + 1)]
    return out


_PLANS: dict[tuple[int, int], list] = {}


def _plan(n: int, most: int) -> list[tuple[int, int, int, int]]:
    plan = _PLANS.get((n, most))
    if plan is None:
        plan = _PLANS[n, most] = probes(n, most)
    return plan


def signatures(line: str, most: int) -> list[int]:
    """64-bit keys, one of which at least two lines within ``most`` edits have in common."""
    plan = _plan(len(line), most)
    digest = xxhash.xxh64_intdigest
    return list({digest(line[s : s + size], (length << 8) | i) for length, i, s, size in plan})


def _lines(raw: np.ndarray, cuts: np.ndarray) -> tuple[dict[str, int], list[list[str]]]:
    """A block's distinct lines that are not blank, numbered as they come; all lines by document."""
    number: dict[str, int] = {}
    documents = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        lines = raw[a:b].tobytes().decode("utf-8", "surrogatepass").split("\n")
        documents.append(lines)
        for x in lines:
            if x not in number and x.strip():
                number[x] = len(number)
    return number, documents


def _firsts(number: dict[str, int], documents: list, ids: list) -> np.ndarray:
    """Each numbered line's first occurrence in the block: id (null last), place in the block, line."""
    key = blocks.id_order(ids)
    first = np.zeros((len(number), 3), np.int64)
    seen = np.zeros(len(number), bool)
    for d in np.argsort(key, kind="stable").tolist():
        for j, x in enumerate(documents[d]):
            i = number.get(x)
            if i is not None and not seen[i]:
                seen[i] = True
                first[i] = key[d], d, j
    return first


def _signed(batches: Iterator[pa.RecordBatch], most: int, least: int, parts: int, out: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per block: rows of kind 0 (hashes of lines and their first occurrences) and 1 (signatures), by part."""
    for b in batches:
        for block, ids, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            raw, cuts = blocks.open_texts(data)
            number, documents = _lines(raw, cuts)
            first = _firsts(number, documents, ids)
            hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in number), ">u8").reshape(-1, 2).astype(np.uint64)
            sizes, keys = [], []
            for x in number:
                k = signatures(x, most) if len(x) >= least else []
                sizes.append(len(k))
                keys += k
            keys, owner = np.array(keys, np.uint64), np.repeat(np.arange(len(sizes)), np.array(sizes, np.int64))
            rows = []
            for p, o in blocks.places((hashes[:, 0] % np.uint64(parts)).astype(np.int64)).items():
                rows.append((block, p, 0, hashes[o].tobytes() + first[o].tobytes() + o.astype(np.uint32).tobytes()))
            for p, o in blocks.places((keys % np.uint64(parts)).astype(np.int64)).items():
                rows.append((block, p, 1, len(o).to_bytes(8, "little") + keys[o].tobytes() + blocks.pack(np.diff(owner[o], prepend=0))))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def _met(table: pa.Table, out: pa.Schema) -> pa.Table:
    """One part: kind 0, lines whose first occurrence is in another block; kind 1, lines with a signature
    that other lines have too, and which. Both go back to their blocks."""
    part = table["part"][0].as_py()
    names = table["block"].to_pylist()
    rows = []
    lines, keys = [], []
    for i, (kind, data) in enumerate(zip(table["kind"].to_pylist(), table["data"].to_pylist(), strict=True)):
        if kind == 0:
            m = len(data) // 44
            lines.append((np.frombuffer(data, np.uint64, 2 * m).reshape(m, 2), np.frombuffer(data, np.int64, 3 * m, 16 * m).reshape(m, 3), np.frombuffer(data, np.uint32, m, 40 * m), np.full(m, i)))
        else:
            m = int.from_bytes(data[:8], "little")
            keys.append((np.frombuffer(data, np.uint64, m, 8), np.cumsum(blocks.unpack(data[8 + 8 * m :])), np.full(m, i)))
    if lines:
        h, first, line, owner = (np.concatenate(x) for x in zip(*lines, strict=True))
        block = np.array(names, np.int64)[owner]
        o = np.lexsort((first[:, 2], first[:, 1], block, first[:, 0], h[:, 1], h[:, 0]))
        again = np.r_[False, (h[o][1:] == h[o][:-1]).all(1)]
        rows += _answers(o[again], owner, line, None, names, part, 0)
    if keys:
        k, line, owner = (np.concatenate(x) for x in zip(*keys, strict=True))
        o = np.argsort(k, kind="stable")
        same = k[o][1:] == k[o][:-1]
        hit = np.r_[False, same] | np.r_[same, False]
        rows += _answers(o[hit], owner, line, k, names, part, 1)
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def _answers(pick: np.ndarray, owner: np.ndarray, line: np.ndarray, keys: np.ndarray | None, names: list, part: int, kind: int) -> list[tuple]:
    pick = pick[np.lexsort((line[pick], owner[pick]))]
    cuts = np.searchsorted(owner[pick], np.arange(len(names) + 1))
    rows = []
    for i, block in enumerate(names):
        y = pick[cuts[i] : cuts[i + 1]]
        if len(y):
            rows.append((block, part, kind, blocks.pack(np.diff(line[y].astype(np.int64), prepend=0)), keys[y].tobytes() if keys is not None else None))
    return rows


def _answered(table: pa.Table, kind: int) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
    """A block's answers of one kind: part, lines, signatures."""
    out = []
    for p, k, d, keys in zip(*(table[c].to_pylist() for c in ("part", "kind", "data", "keys")), strict=True):
        if k == kind:
            out.append((p, np.cumsum(blocks.unpack(d)), np.frombuffer(keys, np.uint64) if keys is not None else None))
    return out


def _open(table: pa.Table):
    at = table["kind"].to_pylist().index(-1)
    ids = table["ids"][at].as_py()
    raw, cuts = blocks.open_texts(table["data"][at].as_py())
    number, documents = _lines(raw, cuts)
    return ids, number, documents, _firsts(number, documents, ids)


def _told(table: pa.Table, out: pa.Schema) -> pa.Table:
    """A block's first occurrences of lines that share a signature with other lines, by the signature's part."""
    rows = []
    if asked := _answered(table, 1):
        _, number, _, first = _open(table)
        stays = np.ones(len(number), bool)
        for _, line, _ in _answered(table, 0):
            stays[line] = False
        text = list(number)
        for part, line, keys in asked:
            ok = stays[line]
            line, keys = line[ok], keys[ok]
            if len(line):
                sizes, raw = blocks.pack_words([text[i].encode("utf-8", "surrogatepass") for i in line.tolist()])
                rows.append((table["block"][0].as_py(), part, keys.tobytes() + first[line].tobytes() + line.astype(np.int64).tobytes(), blocks.pack_many(sizes, raw)))
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def _bags(texts: list[str]) -> np.ndarray:
    """Counts of code points in _BAG classes; an edit moves two of them by one at most."""
    out = np.zeros((_BAG, len(texts)), np.int16)
    for i, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
        out[:, i] = np.minimum(np.bincount(points * np.uint32(2654435761) >> np.uint32(27), minlength=_BAG), 30_000)
    return out


class Repeats:
    """Which lines (numbers in ``texts``, in order of occurrence) are within ``most`` edits of an earlier one.

    A line is settled by the first earlier line found, so pairs are looked at only for lines that aren't.
    A group of lines that share a segment, if it has many pairs to look at, is cut once more: what the
    lines have in common at both ends is taken off, the shared segment is taken out, and what is left is
    within ``most`` edits too, so two such lines share a segment of that. Small groups come first; they
    settle lines, which larger ones then need not look at.
    """

    def __init__(self, texts: list[str], most: int) -> None:
        self.texts, self.most = texts, most
        self.found: set[int] = set()
        self.seen: set[tuple[int, ...]] = set()
        self.bags: dict[int, np.ndarray] = {}

    def settle(self, group: list[tuple[int, str]], cuts: int = 0) -> None:
        """``group``: lines and what is left of them after so many ``cuts``. Equal groups are settled once."""
        own = sorted({i for i, _ in group})
        open_ = [i for i in own[1:] if i not in self.found]
        if not open_ or (name := tuple(own)) in self.seen:
            return
        last = cuts == _CUTS or len(open_) * len(own) <= _PAIRS
        if last:
            self.seen.add(name)
            self._compare(open_, own)
            return
        rest = [r for _, r in group]
        head = len(commonprefix(rest))
        tail = min(len(commonprefix([r[::-1] for r in rest])), min(map(len, rest)) - head)
        cut: dict[object, list[tuple[int, str]]] = defaultdict(list)
        for i, r in group:
            r = r[head : len(r) - tail]
            for length, part, at, size in _plan(len(r), self.most):
                cut[length, part, r[at : at + size]].append((i, r[:at] + r[at + size :]))
            if len(r) <= 2 * self.most:  # too short for each segment to have a code point
                cut[None].append((i, r))
        short = cut.pop(None, [])
        for _, part in sorted(cut.items(), key=lambda x: len(x[1])):
            if len(part) > 1:
                self.settle(part, cuts + 1)
        if len(short) > 1:
            names = sorted({i for i, _ in short})
            self._compare([i for i in names[1:] if i not in self.found], names)
        if not cuts:
            self.seen.add(name)

    def _compare(self, open_: list[int], own: list[int]) -> None:
        """Lines of ``open_`` with the earlier ones of ``own``; among many, lengths and code points rule most out."""
        texts, most = self.texts, self.most
        if len(own) <= _LARGE:
            for j in open_:
                if any(edit_distance(texts[i], texts[j], most) <= most for i in own if i < j):
                    self.found.add(j)
            return
        if new := [i for i in own if i not in self.bags]:
            made = _bags([texts[i] for i in new])
            self.bags.update((i, made[:, k].copy()) for k, i in enumerate(new))
        bags = np.stack([self.bags[i] for i in own], 1)
        sizes, names = np.array([len(texts[i]) for i in own]), np.array(own)
        for j in open_:
            k = int(np.searchsorted(names, j))
            near = np.flatnonzero((np.abs(bags[:, :k] - bags[:, k : k + 1]).sum(0) <= 2 * most) & (np.abs(sizes[:k] - sizes[k]) <= most))
            if any(edit_distance(texts[own[i]], texts[j], most) <= most for i in near.tolist()):
                self.found.add(j)


def repeated(texts: list[str], groups: dict[int, list[int]], most: int) -> set[int]:
    """Lines (numbers in ``texts``, which are in order of occurrence) within ``most`` edits of an earlier one.

    ``groups`` are those of lines with one of signatures() in common. A large one is opened again by all
    segments of its lines, so it doesn't matter which of them it stands for.
    """
    out = Repeats(texts, most)
    for g in sorted(groups.values(), key=len):
        out.settle([(i, texts[i]) for i in set(g)])
    return out.found


def _verified(table: pa.Table, most: int, out: pa.Schema) -> pa.Table:
    """One part: lines that have an earlier line within ``most`` edits, back to their blocks (kind 2)."""
    names, part = table["block"].to_pylist(), table["part"][0].as_py()
    keys, first, line, owner, texts = [], [], [], [], []
    for i, (data, text) in enumerate(zip(table["data"].to_pylist(), table["text"].to_pylist(), strict=True)):
        m = len(data) // 40
        keys.append(np.frombuffer(data, np.uint64, m))
        first.append(np.frombuffer(data, np.int64, 3 * m, 8 * m).reshape(m, 3))
        line.append(np.frombuffer(data, np.int64, m, 32 * m))
        owner.append(np.full(m, i))
        sizes, raw = blocks.unpack_many(text, (1,))
        texts += [x.decode("utf-8", "surrogatepass") for x in blocks.unpack_words(sizes, raw)]
    keys, first, line, owner = (np.concatenate(x) for x in (keys, first, line, owner))
    block = np.array(names, np.int64)[owner]
    order = np.lexsort((line, first[:, 2], first[:, 1], block, first[:, 0]))
    one = {}  # a line has a row for each of its signatures
    groups: dict[int, list[int]] = defaultdict(list)
    where = []
    for x in order.tolist():
        at = (int(owner[x]), int(line[x]))
        if at not in one:
            one[at] = len(where)
            where.append(x)
        groups[int(keys[x])].append(one[at])
    found = repeated([texts[x] for x in where], {k: g for k, g in groups.items() if len(g) > 1}, most)
    pick = np.array([where[i] for i in found], np.int64)
    rows = _answers(pick, owner, line, None, names, part, 2)
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def _kept(table: pa.Table, out: pa.Schema) -> pa.Table:
    """A block's documents without repeated lines."""
    ids, number, documents, first = _open(table)
    extra = table["extra"][table["kind"].to_pylist().index(-1)].as_py() if "extra" in table.column_names else None
    gone = np.zeros(len(number), bool)
    for kind in (0, 2):
        for _, line, _ in _answered(table, kind):
            gone[line] = True
    rows = []
    for d, lines in enumerate(documents):
        kept = []
        for j, x in enumerate(lines):
            i = number.get(x)
            if i is None or (not gone[i] and first[i, 1] == d and first[i, 2] == j):
                kept.append(x)
        rows.append((ids[d], len(lines), len(lines) - len(kept), "\n".join(kept), *([extra[d]] if extra else [])))
    return pa.Table.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(out.types)], schema=out)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_EDITS, least: int = LEAST_CHARS, keep: Sequence[str] = ()) -> DataFrame:
    """Takes out each line (between line feeds) that has an earlier line within ``most`` edits.

    Earlier: in a row of smaller id, or before it in the same row; exact repeats have 0 edits; lines are
    those of the input, whether they stay or not. Lines of fewer than ``least`` code points go only as
    exact repeats, and are no other line's earlier one; blank lines (white space only) always stay.
    Returns id_col, n_lines, n_removed, text (the lines that stay) and the columns to ``keep``.

    Lines are cut into ``most`` + 1 segments, of which two lines within that many edits share one, at a
    place and line length that bound which substrings are probed. Signatures (hashes of substrings) move
    without texts; only lines that share one with another line, and occur there first, send their text
    to be compared. Each block sends a line once, however often it occurs, and of a group of like lines
    no pairs are made: what moves is linear in distinct lines.

    Ids are integers; null ids come last, rows of one id in the order in which their blocks were read.
    Null texts count as empty: one empty line, which stays. Texts are taken whole, whatever their length.
    An empty table gives an empty result; columns that aren't named are not read, whatever their names.
    """
    n = partitions(docs)
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*keep).alias("extra")] if keep else []))
    more = f", extra array<{d.schema['extra'].dataType.simpleString()}>" if keep else ""
    arrow = lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    body = "block bigint, ids array<bigint>, data binary" + more
    whole = written(d.mapInArrow(partial(blocks.texts, out=arrow(body)), body), "lines-blocks", "uncompressed")
    signed = "block bigint, part int, kind int, data binary"
    found = whole.mapInArrow(partial(_signed, most=most, least=least, parts=n, out=arrow(signed)), signed)
    answer = "block bigint, part int, kind int, data binary, keys binary"
    met = written(by_part(found, n).applyInArrow(grouped(_met, out=arrow(answer)), answer), "lines-met")
    text = whole.select("block", F.lit(-1).alias("part"), F.lit(-1).alias("kind"), "ids", "data", *(["extra"] if keep else []))
    line = "block bigint, part int, data binary, text binary"
    told = text.drop("extra").unionByName(met, allowMissingColumns=True).groupBy("block").applyInArrow(grouped(_told, out=arrow(line)), line)
    near = written(by_part(told, n).applyInArrow(grouped(_verified, most=most, out=arrow(answer)), answer), "lines-near")
    gone = met.where("kind = 0").unionByName(near)
    out = "id bigint, n_lines bigint, n_removed bigint, text string" + (f", extra {d.schema['extra'].dataType.simpleString()}" if keep else "")
    kept = text.unionByName(gone, allowMissingColumns=True).groupBy("block").applyInArrow(grouped(_kept, out=arrow(out)), out)
    return kept.select(F.col("id").alias(id_col), "n_lines", "n_removed", "text", *(F.col("extra").getField(c).alias(c) for c in keep))
