"""Splits of the date line: train, valid and test; walking windows; purged folds."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def date_line(df: DataFrame) -> DataFrame:
    """Distinct dates with their position from 0. A row a date: one window over few rows."""
    return df.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def time_split(dates: DataFrame, train: float = 0.6, valid: float = 0.2, embargo: int = 5) -> DataFrame:
    """date, pos, segment: train, then valid and test after a gap of ``embargo`` dates each; gaps are dropped."""
    n = dates.count()
    a, b = int(n * train), int(n * valid)
    v0 = a + embargo
    t0 = v0 + b + embargo
    if n < 10 or a <= 0 or b <= 0 or t0 >= n:
        raise ValueError(f"{n} dates are too few for this split")
    p = F.col("pos")
    segment = F.when(p < a, "train").when((p >= v0) & (p < v0 + b), "valid").when(p >= t0, "test")
    return dates.withColumn("segment", segment).where("segment is not null")


def walk_forward(dates: DataFrame, train_size: int, test_size: int, embargo: int = 0) -> DataFrame:
    """fold, date, segment: windows that step by ``test_size`` while they fit."""
    n = dates.count()
    spans, at = [], 0
    while at + train_size + embargo + test_size <= n:
        spans.append((len(spans), at, at + train_size, at + train_size + embargo, at + train_size + embargo + test_size))
        at += test_size
    s = _spans(dates.sparkSession, spans, "fold int, a bigint, b bigint, c bigint, d bigint")
    segment = F.when((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")), "train").when((F.col("pos") >= F.col("c")) & (F.col("pos") < F.col("d")), "test")
    j = dates.join(s, (F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("d")))
    return j.select("fold", "date", segment.alias("segment")).where("segment is not null")


def purged_kfold(dates: DataFrame, folds: int = 5, horizon: int = 1, embargo: int = 0) -> DataFrame:
    """fold, date, segment: each fold tests a stretch; training loses the ``horizon`` dates before it, whose
    labels reach into it, and ``embargo`` dates after."""
    n = dates.count()
    if folds < 2 or n < folds:
        raise ValueError("too few dates or folds")
    ends = [int(n * i / folds) for i in range(folds + 1)]
    s = _spans(dates.sparkSession, [(i, ends[i], ends[i + 1]) for i in range(folds)], "fold int, lo bigint, hi bigint")
    p = F.col("pos")
    test = (p >= F.col("lo")) & (p < F.col("hi"))
    train = (p < F.col("lo") - F.lit(horizon)) | (p >= F.col("hi") + F.lit(embargo))
    j = dates.crossJoin(F.broadcast(s))  # a row a fold
    return j.select("fold", "date", F.when(test, "test").when(train, "train").alias("segment")).where("segment is not null")


def _spans(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, ddl))


def boundaries(split: DataFrame) -> dict[str, tuple[date, date]]:
    """First and last date of each segment: what a session freezes."""
    return {r["segment"]: (r["a"], r["b"]) for r in split.groupBy("segment").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}


def apply_boundaries(df: DataFrame, frozen: dict[str, tuple]) -> DataFrame:
    """``df`` with the segment of its date; raises if there is no training or no test date."""
    segment = F.lit(None).cast("string")
    for name, (a, b) in frozen.items():
        segment = F.when(F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), name).otherwise(segment)
    out = df.withColumn("segment", segment).where("segment is not null")
    have = {r[0] for r in out.select("segment").distinct().collect()}
    if not {"train", "test"} <= have:
        raise ValueError("the frozen dates leave no training or no test rows")
    return out


class LockedTestSet:
    """Test dates that can be read once."""

    def __init__(self, dates: DataFrame) -> None:
        self._dates, self.reads = dates, 0

    def unlock(self) -> DataFrame:
        self.reads += 1
        if self.reads > 1:
            raise RuntimeError("the test set has been read")
        return self._dates
