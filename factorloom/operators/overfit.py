"""Guards against overfitting: probabilistic and deflated Sharpe, CSCV overfitting probability, the judge."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import workers
from ..plans.compile import evaluate_batch
from ..plans.expr import Node, Registry
from .score import daily_ic, forward_returns, long_short_returns, mean_ic, sharpe

_EULER = 0.5772156649015329
_NORMAL = NormalDist()


def moments(x: Column) -> list[Column]:
    """n, Sharpe, bias-corrected skewness and kurtosis (3 for a normal); 0 and 3 where there are too few."""
    n = F.count(x).cast("double")
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.when(n >= 3, F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)) * g1)
    kurt = F.when(n >= 4, (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * g2 + 6) + 3)
    ok = F.stddev_pop(x) > 0
    return [F.count(x).alias("n"), sharpe(x).alias("sharpe"), F.coalesce(F.when(ok, skew), F.lit(0.0)).alias("skew"), F.coalesce(F.when(ok, kurt), F.lit(3.0)).alias("kurt")]


def probabilistic_sharpe(sr: float, n: int, skew: float = 0.0, kurt: float = 3.0, benchmark: float = 0.0) -> float:
    """Probability that the true Sharpe exceeds the benchmark, given length and higher moments."""
    if n < 2:
        return 0.0
    spread = max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)
    return _NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(spread))


def expected_max_sharpe(variance: float, trials: int) -> float:
    """Largest Sharpe that so many trials without skill are expected to show."""
    if trials < 2 or variance <= 0:
        return 0.0
    q = _NORMAL.inv_cdf
    return math.sqrt(variance) * ((1 - _EULER) * q(1 - 1 / trials) + _EULER * q(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, n: int, skew: float, kurt: float, variance: float, trials: int) -> float:
    return probabilistic_sharpe(sr, n, skew, kurt, expected_max_sharpe(variance, trials))


def effective_trials(trials: int, schemes: int = 1, operators: int | None = None, baseline: int | None = None) -> int:
    """Trials times schemes, times the square of how much the palette grew."""
    grown = (operators / baseline) ** 2 if operators and baseline else 1.0
    return max(1, round(trials * schemes * max(1.0, grown)))


def block_moments(returns: DataFrame, blocks: int = 16) -> DataFrame:
    """(fid, block): n, mean, m2 of daily returns (missing: 0), blocks being even stretches of the date line.

    This is all that cross-validation needs, whatever the number of dates.
    """
    line = returns.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    t = line.count()
    s = min(blocks, t) // 2 * 2
    if s < 2:
        raise ValueError("too few dates")
    ends = [int(t * i / s) for i in range(s + 1)]
    block = F.lit(0)
    for i in range(1, s):
        block = F.when(F.col("pos") >= ends[i], F.lit(i)).otherwise(block)
    grid = returns.select("fid").distinct().crossJoin(line.withColumn("block", block))  # dates are few; Spark's own threshold says whether they are broadcast
    full = grid.join(returns, ["fid", "date"], "left").withColumn("r", F.coalesce("ret", F.lit(0.0)))
    return full.groupBy("fid", "block").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), (F.var_pop("r") * F.count("*")).alias("m2"))


def pbo(returns: DataFrame, blocks: int = 16) -> dict[str, float]:
    """Probability of backtest overfitting by combinatorially symmetric cross-validation.

    Each half of the blocks picks its best strategy by Sharpe (the first, on a tie); the other half ranks
    it; the share of logits of that rank at or below 0 is the result. Spark reduces the returns to
    moments per strategy and block, a matrix of blocks by strategies; halves are dealt to executors as ranges of
    bits, and merged from the blocks' moments by matrix products there. A pair of counts a task comes back.
    """
    spark = returns.sparkSession
    rows = block_moments(returns, blocks).groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("block", "n", "mean", "m2"))).alias("x")).orderBy("fid").collect()
    n, mean, m2 = (np.array([[b[c] for b in r["x"]] for r in rows], float).T for c in ("n", "mean", "m2"))
    s = len(n)
    halves = spark.range(1 << s).where(F.bit_count("id") == s // 2)
    got = halves.mapInArrow(partial(workers.splits, n=n, mean=mean, m2=m2), "splits bigint, low bigint").agg(F.sum("splits").alias("splits"), F.sum("low").alias("low")).first()
    return {"pbo": got["low"] / got["splits"], "splits": got["splits"], "strategies": len(rows)}


def tree_returns(panel: DataFrame, trees: Sequence[Node], horizon: int = 1, registry: Registry | None = None) -> DataFrame:
    """Long-short returns of all trees: fid, date, ret."""
    return long_short_returns(evaluate_batch(forward_returns(panel, horizon), trees, registry, keep=("fwd",)), keys=("fid",))


def judge(panel: DataFrame, best: Node, population: Sequence[Node], research: DataFrame, test: DataFrame, trials: int, horizon: int = 1, min_names: int = 5, blocks: int = 16, registry: Registry | None = None) -> dict:
    """Verdict on a search's best tree: IC on test dates, deflated Sharpe and PBO on research dates.

    Significant: deflated Sharpe above 0.95 and PBO below 0.5.
    """
    trees = [best, *population]
    values = evaluate_batch(forward_returns(panel, horizon), trees, registry, keep=("fwd",))
    oos = daily_ic(values.where("fid = 0").join(test.select("date"), "date", "left_semi"), min_names=min_names).agg(mean_ic(F.col("ic")).alias("x")).first()["x"]
    returns = long_short_returns(values, keys=("fid",)).join(research.select("date"), "date", "left_semi").cache()
    stats = {r["fid"]: r for r in returns.groupBy("fid").agg(*moments(F.col("ret"))).collect()}
    sharpes = [stats[i]["sharpe"] for i in stats if i > 0]
    variance = float(np.var(sharpes, ddof=1)) if len(sharpes) > 1 else 0.0
    b = stats[0]
    dsr = deflated_sharpe(b["sharpe"], b["n"], b["skew"], b["kurt"], variance, trials)
    over = pbo(returns.where("fid > 0"), blocks) if len(population) > 1 else {"pbo": 1.0, "splits": 0}
    returns.unpersist()
    return {"oos_ic": oos, "sharpe": b["sharpe"], "dsr": dsr, "pbo": over["pbo"], "trials": trials, "significant": dsr > 0.95 and over["pbo"] < 0.5}


__all__ = ["block_moments", "deflated_sharpe", "effective_trials", "expected_max_sharpe", "judge", "moments", "pbo", "probabilistic_sharpe", "tree_returns"]
