"""Quality classifier: a sparse ensemble of rules over text statistics, compiled to column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Most labelled rows that a fit reads, taken in the order of a hash of their ids.
FIT_ROWS = 20_000
#: Rows that each tree is grown on, drawn anew for each.
TREE_ROWS = 4000
#: A document is kept from this score on.
KEEP_SCORE = 0.3


def without_letters(text: Column) -> Column:
    return F.regexp_replace(text, r"\p{L}+", "")


def statistics(text: Column, rest: Column | None = None) -> dict[str, Column]:
    """Statistics of a whole text, all defined for empty texts; words are runs of other than white space.

    ``rest`` is the text without its letters, where most of what is counted is, in a fraction of its length.
    """
    rest = without_letters(text) if rest is None else rest
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    count = F.greatest(F.size(words), F.lit(1)).cast("double")
    times = lambda s: (F.length(rest) - F.length(F.replace(rest, F.lit(s), F.lit("")))) / len(s)
    many = lambda x, p: F.regexp_count(x, F.lit(p)).cast("double")
    return {
        "chars": F.length(text).cast("double"),
        "word_chars": n / count,
        "distinct_words": F.size(F.array_distinct(words)) / count,
        "upper": many(text, r"\p{Lu}") / n,
        "letters": (F.length(text) - F.length(rest)).cast("double") / n,
        "digits": many(rest, "[0-9]") / n,
        "symbols": many(rest, r"[^\p{L}\p{N}\s.,;:!?'\-]") / n,
        "bars": times("|") / count,
        "stops": times(".") / count,
        "commas": times(",") / count,
        "bangs": times("!") / count,
        "line_words": count / (times("\n") + 1.0),
    }


def _statistics(text: Column) -> Column:
    """The same as a struct, for which the text is cut down to its rest once."""
    both = F.array(F.struct(text.alias("text"), without_letters(text).alias("rest")))
    return F.transform(both, lambda x: F.struct(*(c.alias(k) for k, c in statistics(x["text"], x["rest"]).items())))


@dataclass(frozen=True)
class Rules:
    """A fitted ensemble: each rule is a conjunction of (statistic, is_above, cut) with a weight."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, text: Column) -> Column:
        """Probability of label 1 as a column over text."""
        return self.score_of(statistics(text))

    def score_of(self, stats: dict[str, Column]) -> Column:
        z = F.lit(float(self.bias))
        for weight, conditions in self.rules:
            hit = F.lit(True)
            for name, above, cut in conditions:
                hit = hit & ((stats[name] > F.lit(cut)) if above else (stats[name] <= F.lit(cut)))
            z = z + F.when(hit, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-z))


def _split(x: np.ndarray, g: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """Best squared-error cut of gradients ``g`` over columns of ``x``: (gain, column, cut)."""
    best = None
    n, total = len(g), g.sum()
    for j in range(x.shape[1]):
        o = np.argsort(x[:, j], kind="stable")
        v, s = x[o, j], np.cumsum(g[o])[:-1]
        k = np.arange(1, n)
        ok = (v[1:] > v[:-1]) & (k >= least) & (n - k >= least)
        if not ok.any():
            continue
        gain = np.where(ok, s**2 / k + (total - s) ** 2 / (n - k), -np.inf)
        i = int(gain.argmax())
        if best is None or gain[i] > best[0]:
            best = (float(gain[i]), j, float((v[i] + v[i + 1]) / 2))
    return best


def _paths(x: np.ndarray, g: np.ndarray, depth: int, least: int, sofar: tuple, out: list, pred: np.ndarray, rows: np.ndarray) -> None:
    """Grows a tree on gradients; every node below the root adds its path to ``out``."""
    if sofar:
        out.append(sofar)
    cut = _split(x[rows], g[rows], least) if depth and len(rows) >= 2 * least else None
    if cut is None:
        pred[rows] = g[rows].mean() if len(rows) else 0.0
        return
    _, j, at = cut
    above = x[rows, j] > at
    _paths(x, g, depth - 1, least, (*sofar, (j, False, at)), out, pred, rows[~above])
    _paths(x, g, depth - 1, least, (*sofar, (j, True, at)), out, pred, rows[above])


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 30, depth: int = 3, lasso: float = 0.002, steps: int = 600, tree_rows: int = TREE_ROWS) -> Rules:
    """Boosted trees give candidate rules; lasso logistic regression (proximal gradient) weighs them.

    Each tree is grown on ``tree_rows`` rows drawn anew (stochastic boosting); weights are fit on all rows.
    With no rows, rows of one label, or so few that no tree can split them, the ensemble is a constant:
    the smoothed share of label 1.
    """
    n = len(y)
    prior = float(np.clip((y.sum() + 1) / (n + 2), 1e-6, 1 - 1e-6)) if n else 0.5
    bias = float(np.log(prior / (1 - prior)))
    if n == 0 or y.min() == y.max():
        return Rules(bias, ())
    rng = np.random.default_rng(7)
    z, found = np.full(n, bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        pick = np.sort(rng.choice(n, size=min(n, tree_rows), replace=False))
        pred = np.zeros(len(pick))
        own: list = []
        _paths(x[pick], (y - p)[pick], depth, max(3, len(pick) // 400), (), own, pred, np.arange(len(pick)))
        found += own
        for path in own:  # every row, also those that weren't picked, moves by its leaf's mean gradient
            if len(path) == depth:
                hit = _hit(x, path)
                if hit.any():
                    z[hit] += 1.5 * (y - p)[hit].mean()
    rules = list(dict.fromkeys(found))
    if not rules:
        return Rules(bias, ())
    m = np.stack([_hit(x, r) for r in rules], 1).astype(np.float64)
    mean = m.mean(0)
    scale = np.sqrt(np.maximum(mean * (1 - mean), 1e-4))
    a = (m - mean) / scale
    w, b, v, t = np.zeros(a.shape[1]), bias, np.zeros(a.shape[1]), 1.0
    step = 4.0 * n / (np.linalg.norm(a, 2) ** 2 + n)
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ v + b))) - y
        g = v - step * (a.T @ r) / n
        new = np.sign(g) * np.maximum(np.abs(g) - step * lasso, 0)
        b -= step * r.mean()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, w = new + (last - 1) / t * (new - w), new
    keep = [i for i in range(len(rules)) if abs(w[i]) > 1e-6]
    bias = float(b - (w * mean / scale).sum())
    return Rules(bias, tuple((float(w[i] / scale[i]), tuple((names[j], up, at) for j, up, at in rules[i])) for i in keep))


def _hit(x: np.ndarray, path: tuple) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for j, above, at in path:
        ok &= (x[:, j] > at) if above else (x[:, j] <= at)
    return ok


def held_out(id_col: str = "doc_id") -> Column:
    """True for rows no label of which is learnt from: crc32 of the id as text, divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Rules:
    """Fits rules on labelled rows that aren't held out.

    ``fit_rows`` bounds what comes to the driver: the first so many labels by a hash of the id. Rows
    with a null id or label, and labels without a document, are left out.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).alias("__label")).where("__id is not null and __label is not null").where(~held_out("__id"))
    known = known.orderBy(F.xxhash64("__id"), "__id", "__label").limit(fit_rows)
    stats = list(statistics(F.lit("")))
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = d.join(F.broadcast(known), "__id").select("__id", F.col("__label").cast("double"), F.inline(_statistics(text_of("__text")))).toPandas()
    rows = rows.sort_values(["__id", *rows.columns[1:]])
    x = rows[stats].to_numpy(np.float64)
    return fit_rules(x, rows["__label"].to_numpy(np.float64), stats)


def score_quality(docs: DataFrame, rules: Rules, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that its text is good; null texts count as empty.

    All columns stay; one named ``score_col`` is replaced, and so is ``__stats``, which goes. The
    statistics are a step of their own, so that each is computed once and not once per rule. Texts are
    taken whole, whatever their length. An empty table gives an empty result.
    """
    names = list(statistics(F.lit("")))
    d = docs.withColumn("__stats", F.explode(_statistics(text_of(text_col))))
    return d.withColumn(score_col, rules.score_of({k: F.col(f"__stats.{k}") for k in names})).drop("__stats")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores all documents: id_col, held_out, score (0 to 1), predicted (1 from KEEP_SCORE on).

    Labels, language, source and id never enter a score. Null texts count as empty; repeated rows are
    scored alike; without usable labels the score is 0.5. A null id isn't held out. Texts are scored
    whole, whatever their length; an empty table gives an empty result; other columns of either table
    are not read, whatever their names.
    """
    rules = train_quality(docs, labels, id_col, text_col)
    d = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    scored = score_quality(d, rules, "__text")
    return scored.select(F.col("__id").alias(id_col), held_out("__id").alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted"))
