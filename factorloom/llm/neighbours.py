"""Nearest neighbours by stable projections in kd-trees, with a chi-square stopping test."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written

#: Projections, the stopping test's confidence, vectors to a leaf.
PROJECTIONS, CONFIDENCE, LEAF = 40, 0.85, 256
#: Vectors that every query is compared with first, about: a random sample, from which bounds start. Its share at most.
SAMPLE, SAMPLE_SHARE = 2048, 0.125
#: Most points, about, that the top of the tree is made from (TREE_POINTS for each of its cells, if fewer).
TREE_SAMPLE, TREE_POINTS = 1 << 17, 16
#: Vectors to a cell of the top of the tree; a cell with more is cut by a hash.
CELL_ROWS = 8192
#: Pairs that are verified at a time; rounding, as a share of squared norms, that no test may hang on.
_PAIRS, _SLACK = 1 << 14, 1e-9


def chi_square(m: int, p: float) -> float:
    """Quantile of the chi-square distribution of m degrees (Wilson and Hilferty)."""
    return m * (1 - 2 / (9 * m) + NormalDist().inv_cdf(p) * (2 / (9 * m)) ** 0.5) ** 3


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products, each by the same order of additions, so that equal vectors have equal scores."""
    return (vectors * query).sum(-1)


def _halves(points: np.ndarray, rows: np.ndarray, least: int) -> tuple[int, float] | None:
    """Widest coordinate and its middle; None for a leaf or where all points are equal."""
    if len(rows) <= least:
        return None
    p = points[rows]
    axis = int((p.max(0) - p.min(0)).argmax())
    cut = float(np.median(p[:, axis]))
    left = p[:, axis] <= cut
    if left.all():
        cut = float(np.nextafter(p[:, axis].max(), -np.inf))
        left = p[:, axis] <= cut
    return (axis, cut) if left.any() and not left.all() else None


def leaves(points: np.ndarray, least: int) -> list[np.ndarray]:
    """Rows of each leaf of a kd-tree."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        cut = _halves(points, rows, least)
        if cut is None:
            out += [rows[i : i + least] for i in range(0, len(rows), least)]
        else:
            left = points[rows, cut[0]] <= cut[1]
            todo += [rows[left], rows[~left]]
    return out


def top(points: np.ndarray, cells: int) -> tuple[list[tuple[int, float, int, int]], np.ndarray, np.ndarray]:
    """The top of a kd-tree over a sample: its splits (axis, cut, left, right; children below 0 are cells
    -1 - cell), and the cells' lower and upper corners, open ends infinite."""
    m = points.shape[1]
    splits, lows, highs = [], [], []

    def grow(rows: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> int:
        cut = _halves(points, rows, 1) if n > 1 else None
        if cut is None:
            lows.append(lo)
            highs.append(hi)
            return -len(lows)
        axis, at = cut
        i = len(splits)
        splits.append((axis, at, 0, 0))
        left = points[rows, axis] <= at
        hi2, lo2 = hi.copy(), lo.copy()
        hi2[axis] = lo2[axis] = at
        splits[i] = (axis, at, grow(rows[left], n // 2, lo, hi2), grow(rows[~left], n - n // 2, lo2, hi))
        return i

    grow(np.arange(len(points)), cells, np.full(m, -np.inf), np.full(m, np.inf))
    return splits, np.array(lows), np.array(highs)


def _cell_of(points: np.ndarray, splits: list) -> np.ndarray:
    out = np.zeros(len(points), np.int64)
    todo = [(0 if splits else -1, np.arange(len(points)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
        elif len(rows):
            axis, at, left, right = splits[node]
            low = points[rows, axis] <= at
            todo += [(left, rows[low]), (right, rows[~low])]
    return out


class Space:
    """Maps the largest inner product to the least distance and projects: for vectors of norm at most
    ``largest``, one more coordinate makes all norms equal; queries have 0 there.

    Directions are Gaussian (2-stable) ones made orthogonal, and scaled so that a coordinate of a unit
    vector has variance 1: the squared projected distance is the squared distance times about a
    chi-square variable of as many degrees as there are projections, of the same mean and less variance,
    and exact when there are as many projections as dimensions.
    """

    def __init__(self, dims: int, largest: float, projections: int) -> None:
        self.largest, self.projections = largest, min(projections, dims + 1)
        axes = np.random.default_rng(11).standard_normal((dims + 1, self.projections))
        self.axes = np.linalg.qr(axes)[0] * np.sqrt(dims + 1)
        self.full = dims + 1

    def limit(self, confidence: float) -> float:
        """How far, in squared distances, a projected squared distance goes with this confidence: a quantile of
        the chi-square distribution with the mean and the variance of an orthogonal projection."""
        m, d = self.projections, self.full
        if m == d:
            return float(d) * (1 + 1e-9)
        degrees = m * (d + 2) / (d - m)
        return m * chi_square(degrees, confidence) / degrees

    def points(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest**2 - (x * x).sum(1), 0))
        return x @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.axes[:-1]

    def square(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Squared distance of vectors with this inner product (no score yet: infinite)."""
        found = np.maximum(self.largest**2 + (q * q).sum(-1) - 2 * np.where(np.isneginf(score), 0, score), 0)
        return np.where(np.isneginf(score), np.inf, found)


def _outside(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point from each box."""
    out = np.zeros((len(points), len(low)))
    for j in range(points.shape[1]):
        d = np.maximum(np.maximum(low[None, :, j] - points[:, None, j], points[:, None, j] - high[None, :, j]), 0)
        out += d * d
    return out


def _array(column, dims: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten() if isinstance(column, pa.ChunkedArray) and column.num_chunks else column.flatten() if isinstance(column, pa.Array) else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def reached(points: np.ndarray, reach: np.ndarray, splits: list, cells: int) -> list[np.ndarray]:
    """For each cell the rows of ``points`` whose ball (squared radius ``reach``) it touches, going down the tree."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * cells
    todo = [(0 if splits else -1, np.arange(len(points)), np.zeros(len(points)), np.zeros(points.shape))]
    while todo:
        node, rows, far, off = todo.pop()
        if node < 0:
            out[-1 - node] = rows
            continue
        axis, at, left, right = splits[node]
        gap = points[rows, axis] - at
        for child, away in ((left, np.maximum(gap, 0)), (right, np.maximum(-gap, 0))):
            new = np.maximum(off[:, axis], away)
            d = far + new * new - off[:, axis] ** 2
            go = d <= reach[rows]
            if go.any():
                o = off[go]
                o[:, axis] = new[go]
                todo.append((child, rows[go], d[go], o))
    return out


class Best:
    """The k best of each query: (score, id), ties to smaller ids."""

    def __init__(self, n: int, k: int, worst: np.ndarray) -> None:
        self.k, self.worst = k, worst.copy()
        self.ids = [np.zeros(0, np.int64) for _ in range(n)]
        self.scores = [np.zeros(0) for _ in range(n)]

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        s, d = np.r_[self.scores[query], scores], np.r_[self.ids[query], ids]
        o = np.lexsort((d, -s))[: self.k]
        self.scores[query], self.ids[query] = s[o], d[o]
        if len(o) == self.k:
            self.worst[query] = max(self.worst[query], s[o[-1]])

    def verify(self, pairs: tuple[np.ndarray, np.ndarray], query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        """Takes the exact scores of pairs (query, vector), which are in order of query."""
        who, what = pairs
        for lo in range(0, len(who), _PAIRS):
            w, v = who[lo : lo + _PAIRS], what[lo : lo + _PAIRS]
            score = exact(x[v], q[w])
            ok = (score >= self.worst[w]) & (ids[v] != query_ids[w])
            w, v, score = w[ok], v[ok], score[ok]
            cuts = np.flatnonzero(np.diff(w)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(w)], strict=True):
                if b > a:
                    self.add(int(w[a]), ids[v[a:b]], score[a:b])


class Cell:
    """A cell's vectors under a kd-tree of their projections."""

    def __init__(self, space: Space, ids: np.ndarray, x: np.ndarray, least: int) -> None:
        self.space, self.ids, self.x = space, ids, x
        self.p = space.points(x)
        self.norm = (self.p * self.p).sum(1)
        self.parts = leaves(self.p, least)
        self.low = np.array([self.p[r].min(0) for r in self.parts])
        self.high = np.array([self.p[r].max(0) for r in self.parts])
        self.verified = 0

    def search(self, query_ids: np.ndarray, q: np.ndarray, bound: np.ndarray, k: int, limit: float) -> Best:
        """Each query's best of the cell, none below its ``bound`` on the k-th score.

        A query goes through leaves in the order of their boxes' distance to its projection, and in a leaf
        verifies the points whose projected distance the chi-square test doesn't rule out for its k-th best
        so far; it stops at the first leaf whose box the test rules out.
        """
        best = Best(len(q), k, bound)
        pq = self.space.queries(q)
        own = (pq * pq).sum(1)
        far = _outside(pq, self.low, self.high)
        order = np.argsort(far, axis=1, kind="stable")
        slack = _SLACK * (own + self.norm.max(initial=0))
        alive = np.arange(len(q))
        for at in range(len(self.parts)):
            reach = self.space.square(q[alive], best.worst[alive]) * limit + slack[alive]
            going = far[alive, order[alive, at]] <= reach
            alive, reach = alive[going], reach[going]
            if not len(alive):
                break
            turn = order[alive, at]
            for leaf in np.unique(turn):
                here = np.flatnonzero(turn == leaf)
                who, rows = alive[here], self.parts[leaf]
                d = own[who][:, None] + self.norm[rows][None, :] - 2 * (pq[who] @ self.p[rows].T)
                i, j = np.nonzero(d <= reach[here][:, None])
                self.verified += len(i)
                best.verify((who[i], rows[j]), query_ids, q, self.ids, self.x)
        return best


def _cells(batches: Iterator[pa.RecordBatch], dims: int, largest: float, projections: int, k: int, confidence: float, least: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, slice and kind: a slice's vectors come first (kind 0) and are held, its queries
    (kind 1) go through them batch by batch."""
    space = Space(dims, largest, projections)
    limit = space.limit(confidence)
    key, ids, held, cell = None, [], [], None
    for b in batches:
        cells, salts, kinds = (b.column(c).to_numpy() for c in range(3))
        cuts = np.flatnonzero(np.r_[True, (np.diff(cells) != 0) | (np.diff(salts) != 0) | (np.diff(kinds) != 0)]) if len(cells) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(cells)], strict=True):
            if (cells[lo], salts[lo]) != key:
                key, ids, held, cell = (cells[lo], salts[lo]), [], [], None
            part = b.slice(lo, hi - lo)
            name, vec = part.column(3).to_numpy(), _array(part.column(5), dims)
            if kinds[lo] == 0:
                ids.append(name)
                held.append(vec)
                continue
            if not ids:
                continue
            if cell is None:
                cell = Cell(space, np.concatenate(ids), np.concatenate(held), least)
            found = cell.search(name, vec, part.column(4).to_numpy(), k, limit)
            owner = np.repeat(name, [len(f) for f in found.ids])
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(np.concatenate(found.ids)), pa.array(np.concatenate(found.scores))], ["query_id", "vec_id", "score"])


def usable(vec: Column, dims: int) -> Column:
    """Not null, of ``dims`` components, all finite, not all zero."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & (F.size(vec) == dims) & ~F.coalesce(bad, F.lit(True)) & F.exists(vec, lambda x: x != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", projections: int = PROJECTIONS, confidence: float = CONFIDENCE) -> DataFrame:
    """The ``k`` rows of largest inner product with each query row: query_id, rank (from 1), id, score.

    Every vector is indexed: the top of a kd-tree over projections, made from a bounded sample, deals
    vectors to cells; a cell with more than CELL_ROWS vectors (many equal ones, say) is cut by a hash.
    Each query is compared with a random sample of about SAMPLE vectors first; its k-th best there bounds
    its search from the start. It goes down the tree to the cells that the chi-square test doesn't rule
    out, and through each cell's own kd-tree, where projected neighbours are verified until the test
    stops it (Cell.search). Vectors move once, queries once to each cell that they go to, and stream
    through it in batches.

    The result is approximate (each true neighbour is missed with probability 1 - confidence at most);
    scores are exact, in double precision, and ties go to smaller ids. Rows of a null id or a vector that
    is null, zero, not finite or not of the commonest length take no part; rows of the query's own id
    aren't its candidates; other rows of one id count each. With fewer than k candidates all are given.
    A table without vectors or queries gives an empty result; other columns are not read, whatever their
    names.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_query, F.lit(False)).alias("query"))
    sizes = v.where("vec is not null and size(vec) > 0").groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = sizes["d"] if sizes else 1
    v = v.where(F.col("vec_id").isNotNull() & usable(F.col("vec"), dims))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    v = written(v.withColumn("norm", norm).withColumn("u", F.rand(11)), "vectors")
    n, largest, n_queries = v.agg(F.count("*"), F.max("norm"), F.count(F.when(F.col("query"), 1))).first()
    if not n or not n_queries:
        return spark.createDataFrame([], f"query_id bigint, rank int, `{id_col}` bigint, score double")
    cells = max(1, -(-n // CELL_ROWS))
    space = Space(dims, float(largest), projections)
    first = F.col("u") < min(SAMPLE_SHARE, SAMPLE / n)
    some = v.where(first).select("vec_id", "vec").toPandas()
    sample_ids = some["vec_id"].to_numpy(np.int64)
    sample = np.stack(some["vec"].to_numpy()).astype(np.float64) if len(some) else np.zeros((0, dims))
    tree = v.where(F.col("u") >= 1 - min(1.0, min(TREE_SAMPLE, TREE_POINTS * cells + 64) / n)).select("vec").toPandas()["vec"] if cells > 1 else []
    splits, low, _ = top(space.points(np.stack(list(tree)).astype(np.float64)), cells) if len(tree) else ([], [None], None)
    cells, limit = len(low), space.limit(confidence)

    def dealt(batches):
        for b in batches:
            cell = _cell_of(space.points(_array(b.column(1), dims)), splits)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["vec_id", "vec", "cell"])

    def routed(batches):
        for b in batches:
            q, ids = _array(b.column(1), dims), b.column(0).to_numpy()
            best = Best(len(q), k, np.full(len(q), -np.inf))
            for lo in range(0, len(q), 1024):
                score = q[lo : lo + 1024] @ sample.T
                score[ids[lo : lo + 1024, None] == sample_ids[None, :]] = -np.inf
                least = np.sort(score, 1)[:, -k] if score.shape[1] >= k else np.full(len(score), -np.inf)
                slack = _SLACK * space.largest * np.sqrt((q[lo : lo + 1024] ** 2).sum(1)) + 1e-300
                i, j = np.nonzero(score >= np.where(np.isneginf(least), -np.finfo(float).max, least - slack)[:, None])
                best.verify((i + lo, j), ids, q, sample_ids, sample)
            reach = space.square(q, best.worst) * limit
            where = reached(space.queries(q), reach + _SLACK * space.full * (space.largest**2 + (q * q).sum(1)), splits, cells)
            lists: list[list[int]] = [[] for _ in range(len(q))]
            for c, rows in enumerate(where):
                for r in rows.tolist():
                    lists[r].append(c)
            found = pa.array([[{"vec_id": int(a), "score": float(s)} for a, s in zip(x, y, strict=True)] for x, y in zip(best.ids, best.scores, strict=True)], pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(best.worst), pa.array(lists, pa.list_(pa.int64())), found], ["query_id", "vec", "bound", "cells", "found"])

    placed = written(v.where(~first).select("vec_id", "vec").mapInArrow(dealt, "vec_id bigint, vec array<double>, cell bigint"), "vectors-cells")
    counts = placed.groupBy("cell").count().select("cell", F.ceil(F.col("count") / CELL_ROWS).alias("salts"))
    counts = written(counts, "vectors-slices")  # a row a cell, cells are n / CELL_ROWS
    candidates = placed.join(counts, "cell").select("cell", F.pmod(F.xxhash64("vec_id", "vec"), "salts").alias("salt"), F.lit(0).alias("kind"), F.col("vec_id").alias("id"), F.lit(0.0).alias("bound"), "vec")
    asked = v.where("query").select("vec_id", "vec").mapInArrow(routed, "query_id bigint, vec array<double>, bound double, cells array<bigint>, found array<struct<vec_id:bigint,score:double>>")
    asked = written(asked, "vectors-queries")
    going = asked.select("query_id", "vec", "bound", F.explode("cells").alias("cell")).join(counts, "cell")
    going = going.select("cell", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"), F.lit(1).alias("kind"), F.col("query_id").alias("id"), "bound", "vec")
    both = candidates.unionByName(going).repartition(max(partitions(vectors), cells), "cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    options = {"dims": dims, "largest": float(largest), "projections": projections, "k": k, "confidence": confidence, "least": LEAF}
    found = both.mapInArrow(partial(_cells, **options), "query_id bigint, vec_id bigint, score double")
    found = found.unionByName(asked.select("query_id", F.inline("found")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score")
