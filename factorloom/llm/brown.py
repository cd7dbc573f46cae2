"""LM scoring by class-based n-grams: exchange clustering of words, class transitions, word emissions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import blocks
from .common import by_part, grouped, partitions, written

#: Classes; class 0 is the end token's, the last takes the words that aren't seeds before the first sweep.
CLASSES = 48
#: Sweeps of the exchange over the whole vocabulary.
SWEEPS = 2
#: Absolute discount of word counts (its mass goes to unknown words) and weight of the class distribution.
DISCOUNT, BACKOFF = 0.5, 5.0
#: Share of what independence would give, added to class pairs in the exchange.
_SMOOTH = 0.2

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_STATE = "block bigint, part int, tokens bigint, types bigint, top array<struct<w:binary,n:bigint,i:int>>, vocab array<bigint>, data binary"
_CONTEXT = "block bigint, part int, matrix array<bigint>, data binary"


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def tokens_of(text: str) -> Iterator[list[bytes]]:
    """Words of a text with A-Z lower-cased, split at ASCII white space; the end token is left to the counts."""
    yield text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def held_out(id_col: str = "doc_id") -> Column:
    """True for documents that nothing is learnt from: crc32 of the id as text leaves 2 by 7."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _built(batches, parts, out):
    return blocks.build(batches, tokens_of, parts, True, out)


def _counted(table: pa.Table, seeds: int, out: pa.Schema) -> pa.Table:
    """One part's words of all blocks: each word's count over all blocks goes back to every block.

    State rows: counts, the word's number in this part, its place among the part's most
    frequent (from 1; 0: none). One row of block -1 has the part's totals.
    """
    number: dict[bytes, int] = {}
    rows, total = [], np.zeros(1024, np.int64)
    for block, part, data in zip(table["block"].to_pylist(), table["part"].to_pylist(), table["data"].to_pylist(), strict=True):
        sizes, raw, seen = blocks.unpack_many(data, (1,))
        g = np.fromiter((number.setdefault(w, len(number)) for w in blocks.unpack_words(sizes, raw)), np.int64, len(sizes))
        if len(number) > len(total):
            total = np.r_[total, np.zeros(len(number), np.int64)]
        total[g] += seen
        rows.append((block, part, g))
    total = total[: len(number)]
    words = list(number)
    best = sorted(np.flatnonzero(total >= np.sort(total)[-min(seeds, len(total))]).tolist() if len(total) else [], key=lambda i: (-total[i], words[i]))[:seeds]
    best = [i for i in best if total[i] > 0]
    place = np.zeros(len(total), np.int64)
    place[best] = np.arange(1, len(best) + 1)
    part = table["part"][0].as_py()
    top = [{"w": words[i], "n": int(total[i]), "i": k + 1} for k, i in enumerate(best)]
    back = [(-1, part, int(total.sum()), int((total > 0).sum()), top, None, None)]
    back += [(b, p, None, None, None, None, blocks.pack_many(total[g], g, place[g])) for b, p, g in rows]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*back, strict=True), out.types, strict=True)], schema=out)


def _classes(part: int, place: np.ndarray, seeds: dict | None, k: int) -> np.ndarray:
    """Before the first sweep a state's last array holds places, of which ``seeds`` gives classes."""
    if seeds is None:
        return place
    names = np.full(int(place.max(initial=0)) + 1, k - 1)
    for (p, i), c in seeds.items():
        if p == part and i < len(names):
            names[i] = c
    names[0] = k - 1
    return names[place]


def _block(table: pa.Table, seeds: dict | None, k: int):
    """A block's documents and, by rank, its words' counts and classes (k: unknown)."""
    part, data = table["part"].to_pylist(), table["data"].to_pylist()
    doc = part.index(-1)
    ranks, order, n = blocks.unpack_documents(data[doc])
    count, cls = np.zeros(n, np.int64), np.full(n, k)
    for p, d in zip(part, data, strict=True):
        if p >= 0:
            c, _, place = blocks.unpack_many(d)
            count[order[p]] = c
            cls[order[p]] = np.where(c > 0, _classes(p, place, seeds, k), k)
    sizes = np.array(table["sizes"][doc].as_py(), np.int64)
    flags = np.array(table["flags"][doc].as_py(), bool)
    ends = np.cumsum(sizes + 1) - 1  # places of the end tokens
    word = np.ones(len(ranks) + len(sizes), bool)
    word[ends] = False
    seq = np.zeros(len(word), np.int64)
    seq[word] = cls[ranks]
    return table["ids"][doc].as_py(), sizes, flags, ranks, word, seq, ends, count, order


def _contexts(table: pa.Table, seeds: dict | None, k: int, contexts: bool, out: pa.Schema) -> pa.Table:
    """A block's counts of class pairs, and its words' counts of classes to the left and right."""
    block = table["block"][0].as_py()
    _, sizes, flags, ranks, word, seq, _, count, order = _block(table, seeds, k)
    learn = np.repeat(~flags, sizes + 1)
    before = np.r_[0, seq[:-1]]
    matrix = np.bincount(before[learn] * k + seq[learn], minlength=k * k)
    rows = [(block, -1, matrix.tolist(), None)]
    if contexts:
        use = learn[word]
        r = ranks[use].astype(np.uint64) * np.uint64(2 * k)
        left = before[word][use].astype(np.uint64)
        right = np.r_[seq[1:], 0][word][use].astype(np.uint64) + np.uint64(k)
        keys, n = np.unique(np.concatenate([r + left, r + right]), return_counts=True)
        owner = (keys // np.uint64(2 * k)).astype(np.int64)
        code = (keys % np.uint64(2 * k)).astype(np.int64)
        starts = np.searchsorted(owner, np.arange(len(count) + 1))
        for p, o in order.items():
            per = starts[o + 1] - starts[o]
            at = blocks.ragged(starts[o], per)
            rows.append((block, p, None, blocks.pack_many(per, code[at], n[at])))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)


def _exchanged(table: pa.Table, seeds: dict | None, matrix: np.ndarray, out: pa.Schema) -> pa.Table:
    """Moves each word of one part to the class that makes its contexts likeliest, given all others."""
    k = len(matrix)
    m = matrix.astype(np.float64)
    size = m.sum(0)
    expect = _SMOOTH * np.outer(m.sum(1), size) / max(m.sum(), 1.0) + 1e-9
    logs, open_ = np.log(m + expect), size > 0
    open_[0] = False
    part = table["part"][0].as_py()
    states, found = {}, {}
    for block, data, kind in zip(table["block"].to_pylist(), table["data"].to_pylist(), table["kind"].to_pylist(), strict=True):
        (states if kind == 0 else found)[block] = blocks.unpack_many(data)
    n_words = max((int(s[1].max(initial=-1)) + 1 for s in states.values()), default=0)
    total, own = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64)
    keys, counts = [], []
    for block, (c, g, place) in states.items():
        total[g], own[g] = c, _classes(part, place, seeds, k)
        per, code, n = found[block]
        keys.append(np.repeat(g, per) * (2 * k) + code)
        counts.append(n)
    keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    o = np.argsort(keys, kind="stable")
    keys, counts = keys[o], counts[o]
    step, new = 1 << 13, own.copy()
    for lo in range(0, n_words, step):
        hi = min(lo + step, n_words)
        a, b = np.searchsorted(keys, [lo * 2 * k, hi * 2 * k])
        dense = np.bincount(keys[a:b] - lo * 2 * k, weights=counts[a:b], minlength=(hi - lo) * 2 * k).reshape(hi - lo, 2 * k)
        left, right, n, c = dense[:, :k], dense[:, k:], total[lo:hi].astype(np.float64), own[lo:hi]
        score = left @ logs + right @ logs.T - 2 * n[:, None] * np.log(np.maximum(size, 1.0))
        alone = (left * np.log(np.maximum(m.T[c] - left, 0) + expect.T[c])).sum(1) + (right * np.log(np.maximum(m[c] - right, 0) + expect[c])).sum(1)
        score[np.arange(hi - lo), c] = alone - 2 * n * np.log(np.maximum(size[c] - n, 1.0))
        score[:, ~open_] = -np.inf
        if open_.any():
            best = score.argmax(1)
            new[lo:hi] = np.where(n > 0, best, c)
    vocab = np.bincount(new[total > 0], minlength=k)
    rows = [(-1, part, None, None, None, vocab.tolist(), None)]
    rows += [(b, part, None, None, None, None, blocks.pack_many(c, g, new[g])) for b, (c, g, _) in states.items()]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)], schema=out)


def _scored(table: pa.Table, seeds: dict | None, matrix: np.ndarray, vocab: np.ndarray, n_all: int, v_all: int, n_docs: int, out: pa.Schema) -> pa.Table:
    """A block's documents: token counts, the base's and the model's log10 probability."""
    k = len(matrix)
    ids, sizes, flags, ranks, word, seq, ends, count, _ = _block(table, seeds, k)
    move, size, unknown = transitions(matrix, vocab)
    full = np.zeros(len(word), np.int64)
    full[word] = count[ranks]
    full[ends] = n_docs
    known = full > 0
    before = np.r_[0, seq[:-1]]
    before[np.r_[0, ends[:-1] + 1] if len(ends) else []] = 0
    if n_all:
        seq = np.where(known, seq, k)
        emit = np.log10(np.maximum(full - DISCOUNT, 1e-300)) - np.log10(np.maximum(np.r_[size, 1.0][seq], 1e-300))
        logp = np.where(known, move[before, np.minimum(seq, k - 1)] + emit, unknown[before])
    else:
        logp = np.zeros(len(word))
    base = np.log10(full + 1.0) - np.log10(n_all + v_all + 1.0)
    first = ends - sizes
    add = lambda x: np.add.reduceat(x, first) if len(first) else x[:0]
    columns = [ids, flags, sizes + 1, add(known.astype(np.int64)), np.full(len(ids), n_all), add(base), add(logp)]
    return pa.Table.from_arrays([pa.array(c if isinstance(c, list) else c.tolist(), t) for c, t in zip(columns, out.types, strict=True)], schema=out)


def transitions(matrix: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 P(class | class before), tokens per class, log10 P(unknown word | class before).

    The row after the last stands for an unknown word before. Over all classes' words and the unknown
    word, probabilities sum to 1: a known word has P(class) (count - DISCOUNT) / tokens of its class.
    """
    size = matrix.sum(0).astype(np.float64)
    prior = size / max(size.sum(), 1.0)
    rows = np.vstack([matrix, np.zeros(len(matrix))]).astype(np.float64)
    p = (rows + BACKOFF * prior) / (rows.sum(1, keepdims=True) + BACKOFF)
    mass = np.where(size > 0, DISCOUNT * vocab / np.maximum(size, 1.0), 0.0)
    with np.errstate(divide="ignore"):
        return np.log10(p), size, np.log10(np.maximum(p @ mass, 1e-300))


def _matrix(rows: DataFrame, k: int) -> np.ndarray:
    """Sum of the blocks' class pairs: k * k numbers, whatever the corpus."""
    got = rows.where("part = -1").select(F.posexplode("matrix")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    out = np.zeros(k * k, np.int64)
    for r in got:
        out[r["pos"]] = r["n"]
    return out.reshape(k, k)


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, classes: int = CLASSES, sweeps: int = SWEEPS) -> DataFrame:
    """Scores every whole text by a class model learnt from the texts that aren't ``held``.

    Returns id_col, held_out, n_tokens, n_known, train_tokens, base_score, score. A token's probability
    is P(class | class before) P(word | class); unknown words are one more word, whose share is what
    discounting takes from the counts. Every text starts after an end token.

    Counts, clustering and transitions cover all training text and its whole vocabulary. Blocks
    (blocks.py) hold documents as word numbers; each part of the vocabulary adds up its words' counts
    and contexts over all blocks, moves its words (all parts at once, each word against the class pairs
    of the sweep before), and sends classes back by block. Only class pairs (classes ** 2) and the seeds
    come to the driver. Null texts count as empty: one end token. Null ids aren't held out and keep
    their row, repeated rows too. Without training text all tokens are unknown and scores 0. Texts are
    scored whole, whatever their length; an empty table gives an empty result; other columns are not read,
    whatever their names.
    """
    n, k = partitions(docs), classes
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (held if held is not None else held_out(id_col)).alias("flag"))
    id_type = d.schema["id"].dataType.simpleString()
    ddl = blocks.schema(id_type)
    rows = written(d.mapInArrow(partial(_built, parts=n, out=_arrow(ddl)), ddl), "brown-blocks")
    n_docs = rows.where("part = -1").agg(F.sum(F.size(F.filter("flags", lambda x: ~x)))).first()[0] or 0
    words = rows.where("part >= 0").select("block", "part", "data")
    state = written(by_part(words, n).applyInArrow(grouped(_counted, seeds=k - 2, out=_arrow(_STATE)), _STATE), "brown-counts")
    sums = state.where("block = -1").agg(F.sum("tokens"), F.sum("types")).first()
    n_all, v_all = (sums[0] or 0) + n_docs, (sums[1] or 0) + (n_docs > 0)
    tops = state.where("block = -1").select("part", F.inline("top")).orderBy(F.desc("n"), "w").limit(k - 2).collect()
    seeds = {(r["part"], r["i"]): c + 1 for c, r in enumerate(tops)}
    vocab = np.array([1, *[1] * len(tops), *[0] * (k - 2 - len(tops)), max(0, v_all - 1 - len(tops))])
    documents = rows.where("part = -1")
    for _ in range(sweeps):
        found = written(_with(documents, state).groupBy("block").applyInArrow(grouped(_contexts, seeds=seeds, k=k, contexts=True, out=_arrow(_CONTEXT)), _CONTEXT), "brown-contexts")
        matrix = _matrix(found, k)
        both = state.where("block >= 0").select("block", "part", "data", F.lit(0).alias("kind"))
        both = both.unionByName(found.where("part >= 0").select("block", "part", "data", F.lit(1).alias("kind")))
        state = written(by_part(both, n).applyInArrow(grouped(_exchanged, seeds=seeds, matrix=matrix, out=_arrow(_STATE)), _STATE), "brown-classes")
        seeds = None
        got = state.where("block = -1").select(F.posexplode("vocab")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
        vocab = np.zeros(k, np.int64)
        vocab[0] = 1
        for r in got:
            vocab[r["pos"]] += r["n"]
    pairs = _with(documents, state).groupBy("block").applyInArrow(grouped(_contexts, seeds=seeds, k=k, contexts=False, out=_arrow(_CONTEXT)), _CONTEXT)
    matrix = _matrix(pairs, k)
    out = f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    scored = _with(documents, state).groupBy("block").applyInArrow(grouped(_scored, seeds=seeds, matrix=matrix, vocab=vocab, n_all=int(n_all), v_all=int(v_all), n_docs=int(n_docs), out=_arrow(out)), out)
    return scored.withColumnRenamed("id", id_col)


def _with(documents: DataFrame, state: DataFrame) -> DataFrame:
    return documents.unionByName(state.where("block >= 0").select("block", "part", "data"), allowMissingColumns=True)
