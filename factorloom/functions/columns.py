"""Column helpers for one rule of missing values: NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")


def nn(x: Column) -> Column:
    """NaN to NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def fin(x: Column) -> Column:
    """NaN and infinities to NULL."""
    x = nn(x)
    return F.when((x < INF) & (x > -INF), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b where b isn't zero, finite or NULL; never the engine's error on division by zero."""
    return fin(a / F.nullif(b, F.lit(0.0)))


def quotient(a: Column, b: Column) -> Column:
    """a / b as floating point has it: infinite over zero, and NULL for 0 / 0."""
    over_zero = F.when(a > 0, F.lit(INF)).when(a < 0, F.lit(-INF))
    return nn(F.when(b == 0, over_zero).otherwise(a / F.nullif(b, F.lit(0.0))))


def by_symbol(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "symbol").orderBy("date")


def by_date(*more: str) -> WindowSpec:
    return Window.partitionBy(*more, "date")


def trailing(w: int, *more: str) -> WindowSpec:
    return by_symbol(*more).rowsBetween(-(w - 1), 0)


def average_rank(v: Column, *keys: str) -> Column:
    """Rank among non-missing values of ``keys``, from 1, ties averaged; NULL where v is NULL."""
    over = Window.partitionBy(*keys)
    return F.when(v.isNotNull(), F.rank().over(over.orderBy(v.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, v)) - 1) / 2)


def percent_rank(v: Column, *keys: str) -> Column:
    """Average rank over the number of non-missing values."""
    return average_rank(v, *keys) / F.count(v).over(Window.partitionBy(*keys))


def pearson(a: Column, b: Column, least: int = 2) -> Column:
    """Correlation as an aggregate over rows where both are present; NULL below ``least`` pairs or without variance."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.when(F.count(x) >= max(2, least), ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
