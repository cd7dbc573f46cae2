"""Matrix work of executors: what Arrow batches become there. Sent by value, so executors need not have this package."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Doubles of one matrix that a task works on at a time.
CHUNK = 1 << 21


def gram(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fid, x), a cell's rows one after another, to sums over the cells that two factors share:
    (fid_a, fid_b, n, sa, sb, saa, sbb, sab), fid_a < fid_b.

    Some cells at a time become a matrix of cells by factors; its products with itself, its squares and its
    mask are added up, so what a task holds and gives out is factors squared, however many cells it has.
    """
    place: dict[int, int] = {}
    sums = np.zeros((4, 0, 0))  # n, sum of a where b is, sum of a squared where b is, sum of a b

    def add(key: np.ndarray, fid: np.ndarray, x: np.ndarray) -> None:
        nonlocal sums
        names, own = np.unique(fid, return_inverse=True)
        col = np.array([place.setdefault(k, len(place)) for k in names.tolist()], np.int64)[own]
        f = len(place)
        sums = np.pad(sums, ((0, 0), (0, f - sums.shape[1]), (0, f - sums.shape[2])))
        cell = np.r_[0, np.cumsum(key[1:] != key[:-1])]
        step = max(1, most // f)
        for lo in range(0, int(cell[-1]) + 1, step):
            some = slice(*np.searchsorted(cell, (lo, lo + step)))
            values, there = np.zeros((min(step, int(cell[-1]) + 1 - lo), f)), np.zeros((min(step, int(cell[-1]) + 1 - lo), f))
            values[cell[some] - lo, col[some]], there[cell[some] - lo, col[some]] = x[some], 1.0
            sums += [there.T @ there, values.T @ there, (values**2).T @ there, values.T @ values]

    held = None  # the last cell so far, which may go on
    for b in batches:
        if not len(b):
            continue
        rows = [b.column(c).to_numpy(zero_copy_only=False) for c in range(3)]
        if held is not None:
            rows = [np.concatenate(c) for c in zip(held, rows, strict=True)]
        cut = len(rows[0]) - int(np.argmax(np.append((rows[0] != rows[0][-1])[::-1], True)))
        if cut:
            add(*(c[:cut] for c in rows))
        held = [c[cut:] for c in rows]
    if held is not None:
        add(*held)
    names = np.array(list(place), np.int64)
    a, b = np.nonzero((sums[0] > 0) & (names[:, None] < names[None, :]))
    n, s, ss, ab = sums
    columns = (names[a], names[b], n[a, b].astype(np.int64), s[a, b], s[b, a], ss[a, b], ss[b, a], ab[a, b])
    for lo in range(0, len(a), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in columns], ["fid_a", "fid_b", "n", "sa", "sb", "saa", "sbb", "sab"])


def _sharpes(n: np.ndarray, s1: np.ndarray, s2: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """Sharpe from counts, sums and sums of squares of returns less ``shift``."""
    mean = s1 / n
    sd = np.sqrt(np.maximum(s2 - s1 * mean, 0) / np.maximum(n - 1, 1))
    return np.where(sd > 1e-15, (mean + shift) / np.where(sd > 1e-15, sd, 1), 0.0)


def splits(batches: Iterator[pa.RecordBatch], n: np.ndarray, mean: np.ndarray, m2: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Halves of the blocks, as bits, to how many there are and how many rank their best strategy in the lower
    half out of sample: (splits, low). ``n``, ``mean``, ``m2``: blocks by strategies.

    A few hundred halves at a time are a matrix whose products with the blocks' sums are all their Sharpes.
    """
    blocks, strategies = n.shape
    shift = (n * mean).sum(0) / n.sum(0)  # sums of squares about it lose no digits
    mean = mean - shift
    sums = n, n * mean, m2 + n * mean**2
    whole = [x.sum(0) for x in sums]
    step = max(1, CHUNK // max(1, strategies) // 4)
    count = low = 0
    for bits in chain.from_iterable(np.array_split(x, -(-len(x) // step)) for b in batches if len(x := b.column(0).to_numpy())):
        half = ((bits[:, None] >> np.arange(blocks)) & 1).astype(float)
        own = [half @ x for x in sums]
        best = _sharpes(*own, shift).argmax(1)
        out = _sharpes(*(w - x for w, x in zip(whole, own, strict=True)), shift)
        mark = out[np.arange(len(bits)), best][:, None]
        rank = (out < mark).sum(1) + ((out == mark).sum(1) + 1) / 2
        omega = np.clip(rank / (strategies + 1), 1e-6, 1 - 1e-6)
        count, low = count + len(bits), low + int((np.log(omega / (1 - omega)) <= 0).sum())
    yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64()), pa.array([low], pa.int64())], ["splits", "low"])
