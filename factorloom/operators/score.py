"""Scores of factors: forward returns, daily information coefficients and their summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import workers
from ..functions.columns import average_rank, by_symbol, pearson, ratio
from ..plans.compile import evaluate_batch
from ..plans.expr import Node, Registry

#: A factor with fewer valid dates scores minus its size penalty.
LEAST_DATES = 5


def forward_returns(panel: DataFrame, horizon: int = 1, name: str = "fwd") -> DataFrame:
    """The one-row return ``horizon`` rows ahead, on the dense grid."""
    return panel.withColumn(name, F.lead("returns", horizon).over(by_symbol()))


def daily_ic(values: DataFrame, value: str = "value", fwd: str = "fwd", method: str = "spearman", min_names: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Per date (and key) the correlation of values and forward returns over cells that have both.

    Spearman ranks each side, ties averaged, after cells without the other side are left out.
    """
    if method not in ("spearman", "pearson"):
        raise ValueError(f"unknown method {method!r}")
    both = values.where(F.col(value).isNotNull() & F.col(fwd).isNotNull())
    a, b = F.col(value), F.col(fwd)
    if method == "spearman":
        both = both.select(*keys, "date", average_rank(a, *keys, "date").alias("__a"), average_rank(b, *keys, "date").alias("__b"))
        a, b = F.col("__a"), F.col("__b")
    return both.groupBy(*keys, "date").agg(pearson(a, b, min_names).alias("ic"))


def mean_ic(ic: Column, absolute: bool = True) -> Column:
    """Mean of daily IC, or of its size; 0 if there is none."""
    return F.coalesce(F.avg(F.abs(ic) if absolute else ic), F.lit(0.0))


def sharpe(x: Column) -> Column:
    """Mean over sample deviation, not annualised; 0 for fewer than two values or without variance."""
    return F.coalesce(ratio(F.avg(x), F.stddev_samp(x)), F.lit(0.0))


ic_ir = sharpe


def ic_summary(ic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    x = F.col("ic")
    return ic.groupBy(*keys).agg(mean_ic(x).alias("mean_abs_ic"), mean_ic(x, False).alias("mean_ic"), ic_ir(x).alias("ic_ir"), F.count(x).alias("days"))


def score_batch(panel: DataFrame, trees: Sequence[Node], parsimony: float = 1e-3, method: str = "spearman", min_names: int = 5, horizon: int = 1, registry: Registry | None = None) -> DataFrame:
    """All trees in one job: fid, ic (mean daily size), fitness = ic - parsimony * nodes, days."""
    values = evaluate_batch(forward_returns(panel, horizon), trees, registry, keep=("fwd",))
    s = daily_ic(values, method=method, min_names=min_names, keys=("fid",)).groupBy("fid").agg(mean_ic(F.col("ic")).alias("ic"), F.count("ic").alias("days"))
    sizes = panel.sparkSession.createDataFrame([(i, float(t.size)) for i, t in enumerate(trees)], "fid int, size double")
    j = sizes.join(s, "fid", "left")
    days = F.coalesce("days", F.lit(0))
    ic = F.when(days < LEAST_DATES, F.lit(0.0)).otherwise(F.col("ic"))
    return j.select("fid", ic.alias("ic"), (ic - F.lit(parsimony) * F.col("size")).alias("fitness"), days.alias("days"))


def ic_decay(values: DataFrame, horizons: Sequence[int] = (1, 2, 3, 5, 10), value: str = "value", min_names: int = 5) -> DataFrame:
    """Mean size of rank IC by horizon; ``values`` is dense and has ``returns``. One plan for all horizons."""
    ahead = values.select("date", "symbol", value, *(F.lead("returns", h).over(by_symbol()).alias(f"__h{h}") for h in horizons))
    long = ahead.select("date", "symbol", value, F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"__h{h}").alias("fwd")) for h in horizons))).alias("e"))
    ic = daily_ic(long.select("date", "symbol", value, "e.horizon", "e.fwd"), value, "fwd", "spearman", min_names, ("horizon",))
    return ic.groupBy("horizon").agg(mean_ic(F.col("ic")).alias("mean_abs_ic"))


def long_short_returns(values: DataFrame, value: str = "value", fwd: str = "fwd", keys: Sequence[str] = ()) -> DataFrame:
    """Per date: values demeaned, scaled to unit gross, times forward returns; NULL if no cell has both."""
    from pyspark.sql import Window

    over = Window.partitionBy(*keys, "date")
    d = values.withColumn("__d", F.col(value) - F.avg(value).over(over))
    d = d.withColumn("__w", ratio(F.col("__d"), F.sum(F.abs("__d")).over(over)))
    return d.groupBy(*keys, "date").agg(F.sum(F.col("__w") * F.col(fwd)).alias("ret"))


def rank_correlation(values: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson of two factors' per-date average ranks over cells that have both; ranks are taken before."""
    r = values.select(average_rank(F.col(a), "date").alias("a"), average_rank(F.col(b), "date").alias("b"))
    return r.agg(F.coalesce(pearson(F.col("a"), F.col("b"), 3), F.lit(0.0)).alias("corr"))


def pairwise_rank_correlation(long: DataFrame) -> DataFrame:
    """The same for all pairs of factors of (fid, date, symbol, value): fid_a < fid_b, corr.

    Ranks are dealt by cell, and each task adds up products of matrices of cells by factors, so what moves then
    is a row for each pair of factors and task, and no row for a pair of factors in a cell.
    """
    r = long.select("fid", F.xxhash64("date", "symbol").alias("cell"), average_rank(F.col("value"), "fid", "date").alias("r"), "date", "symbol").where("r is not null")
    cells = r.repartition("date", "symbol").sortWithinPartitions("cell", "date", "symbol").select("cell", F.col("fid").cast("bigint").alias("fid"), "r")
    sums = cells.mapInArrow(workers.gram, "fid_a bigint, fid_b bigint, n bigint, sa double, sb double, saa double, sbb double, sab double")
    all_ = sums.groupBy("fid_a", "fid_b").agg(*(F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")))
    n = F.col("n")
    spread = lambda s, ss: F.sqrt(F.greatest(F.col(ss) / n - (F.col(s) / n) * (F.col(s) / n), F.lit(0.0)))
    corr = ratio(F.col("sab") / n - F.col("sa") / n * F.col("sb") / n, spread("sa", "saa") * spread("sb", "sbb"))
    fid = long.schema["fid"].dataType
    return all_.select(F.col("fid_a").cast(fid).alias("fid_a"), F.col("fid_b").cast(fid).alias("fid_b"), F.coalesce(F.when(n >= 3, corr), F.lit(0.0)).alias("corr"))


def prune(long: DataFrame, fitness: dict[int, float], limit: float = 0.7) -> list[int]:
    """Greedy by fitness: a factor stays if its size of correlation with all that stay is below ``limit``.

    Only pairs at or beyond the limit come to the driver."""
    near: dict[int, set[int]] = {}
    for r in pairwise_rank_correlation(long).where(F.abs("corr") >= limit).collect():
        near.setdefault(r["fid_a"], set()).add(r["fid_b"])
        near.setdefault(r["fid_b"], set()).add(r["fid_a"])
    kept: dict[int, None] = {}
    for f in sorted(fitness, key=lambda f: -fitness[f]):
        if not near.get(f, set()) & kept.keys():
            kept[f] = None
    return list(kept)


def combine_trees(panel: DataFrame, trees: Sequence[Node], train_end: str | None = None, horizon: int = 1, registry: Registry | None = None) -> DataFrame:
    """The combined signal of trees over a panel: date, symbol, value."""
    p = forward_returns(panel, horizon)
    return combine(evaluate_batch(p, trees, registry), p.select("date", "symbol", "fwd"), train_end)


def combine(long: DataFrame, fwd: DataFrame, train_end: str | None = None) -> DataFrame:
    """One signal of many: the sum of per-date z-scores, each times its mean signed rank IC in training.

    A cell is missing only where all factors are. ``long``: fid, date, symbol, value; ``fwd``: date, symbol, fwd.
    """
    from pyspark.sql import Window

    train = long.join(fwd, ["date", "symbol"])
    if train_end:
        train = train.where(F.col("date") <= F.lit(train_end).cast("date"))
    weight = daily_ic(train, min_names=2, keys=("fid",)).groupBy("fid").agg(mean_ic(F.col("ic"), False).alias("weight"))
    over = Window.partitionBy("fid", "date")
    z = (F.col("value") - F.avg("value").over(over)) / F.nullif(F.stddev_samp("value").over(over), F.lit(0.0))
    scored = long.select("fid", "date", "symbol", z.alias("z")).join(weight, "fid")
    return scored.groupBy("date", "symbol").agg(F.sum(F.col("z") * F.col("weight")).alias("value"))
