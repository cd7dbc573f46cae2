"""Portfolios of a signal: weights, neutralisation, costs, and the backtest."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import average_rank, by_date, by_symbol, percent_rank, ratio
from .score import sharpe

TRADING_DAYS = 252


def quantile_weights(value: Column, q: float = 0.2, keys: Sequence[str] = ("date",)) -> Column:
    """Half long in the top share, half short in the bottom share of the date; a date without both legs is
    flat. A missing value weighs 0."""
    over = Window.partitionBy(*keys)
    pct = percent_rank(value, *keys)
    top, low = F.coalesce(pct >= F.lit(1.0 - q), F.lit(False)), F.coalesce(pct <= F.lit(q), F.lit(False))
    n = lambda x: F.nullif(F.sum(x.cast("double")).over(over), F.lit(0.0))
    w = F.lit(0.5) * top.cast("double") / n(top) - F.lit(0.5) * low.cast("double") / n(low)
    return F.coalesce(w, F.lit(0.0))


def centred_rank(value: Column, keys: Sequence[str] = ("date",)) -> Column:
    """Average rank less the date's mean rank; NULL where the value is missing."""
    return average_rank(value, *keys) - (F.count(value).over(Window.partitionBy(*keys)) + 1) / 2.0


def _rank_frame(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Centred rank over the sum of its sizes; a missing value, or a date without spread, weighs 0."""
    d = df.withColumn("__d", centred_rank(F.col(value), keys))
    return d.withColumn("weight", F.coalesce(ratio(F.col("__d"), F.sum(F.abs("__d")).over(Window.partitionBy(*keys))), F.lit(0.0))).drop("__d")


#: Schemes by name: from (frame, value column, keys) to the frame with ``weight``.
SCHEMES: dict[str, Callable[[DataFrame, str, Sequence[str]], DataFrame]] = {
    "quantile": lambda df, value, keys: df.withColumn("weight", quantile_weights(F.col(value), 0.2, keys)),
    "rank": _rank_frame,
}


def weigh(df: DataFrame, scheme: str = "quantile", value: str = "value", keys: Sequence[str] = ("date",)) -> DataFrame:
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}")
    return SCHEMES[scheme](df, value, keys)


def neutralize_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """Values less their date's group mean; symbols without a group stay as they are."""
    mean = F.avg(value).over(Window.partitionBy("date", group))
    return df.withColumn(value, F.when(F.col(group).isNull(), F.col(value)).otherwise(F.col(value) - mean))


def neutralize_size(df: DataFrame, value: str, size: str) -> DataFrame:
    """Values less their regression on demeaned size, per date; the denominator takes all sizes, also where
    the value is missing, and the result keeps the values' mean."""
    d = df.withColumns({"__s": F.col(size) - F.avg(size).over(by_date()), "__v": F.col(value) - F.avg(value).over(by_date())})
    beta = F.coalesce(F.sum(F.col("__v") * F.col("__s")).over(by_date()), F.lit(0.0)) / F.nullif(F.sum(F.col("__s") * F.col("__s")).over(by_date()), F.lit(0.0))
    return d.withColumn(value, F.col(value) - beta * F.col("__s")).drop("__s", "__v")


def neutralize(df: DataFrame, value: str, group: str | None = None, size: str | None = None) -> DataFrame:
    """Groups first, then size."""
    if group:
        df = neutralize_groups(df, value, group)
    return neutralize_size(df, value, size) if size else df


@dataclass(frozen=True)
class Costs:
    """Basis points of turnover."""

    commission: float = 1.0
    slippage: float = 4.0

    @property
    def rate(self) -> float:
        return (self.commission + self.slippage) / 1e4


def daily_turnover(weights: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per date the sum of sizes of weight changes; the first date's is what the book takes to set up."""
    change = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by_symbol(*keys)), F.lit(0.0)))
    return weights.withColumn("__c", change).groupBy(*keys, "date").agg(F.sum("__c").alias("turnover"))


def backtest_daily(values: DataFrame, scheme: str = "quantile", costs: Costs | None = None, value: str = "value", fwd: str = "fwd", keys: Sequence[str] = ()) -> DataFrame:
    """Per date: gross and net return, turnover, cost, gross exposure, names held, largest weight.

    ``values`` is dense with ``fwd``. One pass by date for weights, one by symbol for changes.
    """
    costs = costs or Costs()
    w = weigh(values, scheme, value, (*keys, "date"))
    change = F.abs(F.col("weight") - F.coalesce(F.lag("weight").over(by_symbol(*keys)), F.lit(0.0)))
    d = w.withColumn("__c", change).groupBy(*keys, "date").agg(
        F.coalesce(F.sum(F.col("weight") * F.col(fwd)), F.lit(0.0)).alias("gross"), F.sum("__c").alias("turnover"),
        F.sum(F.abs("weight")).alias("exposure"), F.count(F.when(F.col("weight") != 0, 1)).alias("names"), F.max(F.abs("weight")).alias("largest"),
    )
    return d.withColumn("cost", F.col("turnover") * F.lit(costs.rate)).withColumn("net", F.col("gross") - F.col("cost"))


def drawdowns(returns: DataFrame, ret: str = "net", keys: Sequence[str] = ()) -> DataFrame:
    """Equity over its running peak less 1. The peak starts at the first equity, so a first loss doesn't show.

    One window per key: a row a date, few whatever the number of symbols.
    """
    over = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    e = returns.withColumn("equity", F.product(1.0 + F.coalesce(ret, F.lit(0.0))).over(over))
    return e.withColumn("drawdown", F.col("equity") / F.nullif(F.max("equity").over(over), F.lit(0.0)) - 1.0)


def summarize(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: Sharpe (daily and annualised), drawdown, mean turnover without the first date, exposure."""
    first = F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date"))
    d = drawdowns(daily, "net", keys).withColumn("__n", first)
    s = sharpe(F.col("net"))
    return d.groupBy(*keys).agg(
        F.avg("gross").alias("mean_gross"), F.avg("net").alias("mean_net"), s.alias("sharpe"), (s * F.sqrt(F.lit(float(TRADING_DAYS)))).alias("annual_sharpe"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.avg(F.when(F.col("__n") > 1, F.col("turnover"))), F.lit(0.0)).alias("mean_turnover"),
        F.avg("exposure").alias("mean_exposure"), F.avg("names").alias("mean_names"), F.max("largest").alias("largest_weight"), (F.avg("net") > 0).alias("usable"),
    )


def backtest(values: DataFrame, scheme: str = "quantile", costs: Costs | None = None, dates: DataFrame | None = None, value: str = "value", fwd: str = "fwd") -> DataFrame:
    """Weights and costs over the whole timeline, figures over ``dates`` (all, if none)."""
    daily = backtest_daily(values, scheme, costs, value, fwd)
    return summarize(daily.join(dates.select("date").distinct(), "date", "left_semi") if dates is not None else daily)


def compare_schemes(values: DataFrame, costs: Costs | None = None, schemes: Sequence[str] = ("quantile", "rank"), value: str = "value", fwd: str = "fwd") -> DataFrame:
    """A row for each scheme."""
    out = None
    for s in schemes:
        one = backtest_daily(values, s, costs, value, fwd).withColumn("scheme", F.lit(s))
        out = one if out is None else out.unionByName(one)
    return summarize(out, ("scheme",))
