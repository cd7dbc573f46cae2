"""Factor tables kept up to date from a stream of events.

Repeats go within a watermark, which also bounds the state; each micro-batch's bars are merged into a table of
bars, and factors are computed anew from the first row that the batch can have changed, symbol by symbol.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.panel import densify, derive, merge
from ..plans.compile import Compiler
from ..plans.expr import BUILTINS, Node, Registry, simplify
from ..sources import files
from ..sources.tables import BUCKETS, SymbolTable

_BARS = "symbol bigint, date date, open double, high double, low double, close double, volume double, open_at struct<ts: {ts}, event_id: bigint>, close_at struct<ts: {ts}, event_id: bigint>, batch bigint"
_FIELDS = ("open", "high", "low", "close", "volume")


def lookback(node: Node) -> int:
    """How many rows of the grid before a cell its value can depend on."""
    w = next((int(c.value) for c in node.children if c.name == "window"), 0)
    own = 0
    if node.name in BUILTINS and BUILTINS[node.name].category == "time_series":
        own = w if node.name in ("delta", "delay") else max(1, w) - 1
    elif node.name == "returns":
        own = 1
    return own + max((lookback(c) for c in node.children), default=0)


def across(node: Node) -> bool:
    """Whether a value depends on other symbols of its date."""
    return any(n.name in BUILTINS and BUILTINS[n.name].category == "cross_sectional" for n in node)


def partial_bars(events: DataFrame, batch: int) -> DataFrame:
    """Daily bars of some events, with what is needed to merge them with others of the same day."""
    at = F.struct("ts", "event_id")
    return events.groupBy(F.col("user_id").cast("bigint").alias("symbol"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume"),
        F.min(at).alias("open_at"), F.max(at).alias("close_at"), F.lit(batch).cast("bigint").alias("batch"),
    )


def merge_bars(old: DataFrame, new: DataFrame) -> DataFrame:
    """Bars of both; a day's bar that has the new bars' batch already isn't given it twice."""
    done = old.select("symbol", "date", F.col("batch").alias("__b"))
    fresh = new.join(done, ["symbol", "date"], "left").where("__b is null or __b < batch").drop("__b")
    return old.unionByName(fresh).groupBy("symbol", "date").agg(
        F.min_by("open", "open_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "close_at").alias("close"), F.sum("volume").alias("volume"),
        F.min("open_at").alias("open_at"), F.max("close_at").alias("close_at"), F.max("batch").alias("batch"),
    )


class FactorTable:
    """Bars and factors under a folder, for one stream: ``bars``, ``factors`` and the ``dates`` of the grid."""

    def __init__(self, spark: SparkSession, path: str, formulas: Mapping[str, Node], ts: str = "timestamp_ntz", registry: Registry | None = None, buckets: int = BUCKETS, infinite: bool = True) -> None:
        registry = registry or Registry()
        self.spark, self.path, self.infinite = spark, path.rstrip("/"), infinite
        self.trees = {k: simplify(registry.expand(registry.validate(n, registry.infer(n)))) for k, n in formulas.items()}
        kinds = {k: registry.infer(n) for k, n in formulas.items()}
        self.bars = SymbolTable(spark, f"{self.path}/bars", T.StructType.fromDDL(_BARS.format(ts=ts)), buckets)
        columns = ", ".join(f"`{k}` {'boolean' if kinds[k] == 'bool' else 'double'}" for k in self.trees)
        self.factors = SymbolTable(spark, f"{self.path}/factors", T.StructType.fromDDL(f"symbol bigint, date date, {columns}"), buckets)
        self.rows_before = max(lookback(t) for t in self.trees.values())
        self.across = any(across(t) for t in self.trees.values())

    def _dates(self) -> DataFrame:
        path = f"{self.path}/dates"
        return self.spark.read.schema("date date").parquet(path).distinct() if files.exists(self.spark, path) else self.spark.createDataFrame([], "date date")

    def apply(self, events: DataFrame, batch: int) -> None:
        """Merges a batch of events. A batch that is run again, whole or from where it broke off, changes nothing."""
        self.bars.recover()
        self.factors.recover()
        new = partial_bars(events, batch).persist()
        try:
            touched = new.agg(F.count("*"), F.min("date")).first()
            if not touched[0]:
                return
            # Rows of the batch that were in place before a break count as touched all the same.
            known = self._dates().persist()
            first_new = new.join(known, "date", "left_anti").agg(F.min("date")).first()[0]
            held = self.bars.read().select("symbol").distinct() if self.bars.exists() else new.select("symbol").limit(0)
            fresh = new.select("symbol").distinct().join(held, "symbol", "left_anti").agg(F.count("*")).first()[0]
            todo = f"{self.path}/todo/batch={batch}"
            if not files.exists(self.spark, f"{todo}/_SUCCESS"):  # decided once, before anything changes
                starts = new.groupBy("symbol").agg(F.min("date").alias("start"))
                grid_start = known.agg(F.min("date")).first()[0]
                if fresh:  # a new symbol has a row for each date of the grid
                    least = min(d for d in (grid_start, touched[1]) if d is not None)
                    starts = starts.join(held, "symbol", "left_semi").unionByName(starts.join(held, "symbol", "left_anti").withColumn("start", F.lit(least)))
                if first_new is not None:  # all later rows move one place
                    every = held.union(new.select("symbol")).distinct().withColumn("start", F.lit(first_new))
                    starts = starts.unionByName(every).groupBy("symbol").agg(F.min("start").alias("start"))
                if self.across:
                    every = held.union(new.select("symbol")).distinct().crossJoin(F.broadcast(starts.agg(F.min("start").alias("start"))))  # one row
                    starts = every
                starts.write.mode("overwrite").parquet(todo)
            known.unpersist()
            self.bars.replace(new, merge_bars)
            new.select("date").distinct().write.mode("append").parquet(f"{self.path}/dates")
            self._recompute(self.spark.read.schema("symbol bigint, start date").parquet(todo))
            files.remove(self.spark, todo)
        finally:
            new.unpersist()

    def _recompute(self, starts: DataFrame) -> None:
        """Factors of each symbol from its start on; the rows before it that they depend on are read too."""
        dates = self._dates()
        least = starts.agg(F.min("start")).first()[0]
        before = dates.where(F.col("date") < F.lit(least)).orderBy(F.desc("date")).limit(self.rows_before)
        read_from = before.agg(F.min("date")).first()[0] or least
        bars = self.bars.read().where(F.col("date") >= F.lit(read_from)).join(starts.select("symbol"), "symbol", "left_semi").select("symbol", "date", *_FIELDS)
        grid = dates.where(F.col("date") >= F.lit(read_from))
        panel = derive(densify(bars, dates=grid, symbols=starts.select("symbol")), self.infinite)
        values = Compiler().run(panel, self.trees).select("symbol", "date", *self.trees)
        tail = values.join(starts, "symbol").where("date >= start").drop("start")
        self.factors.replace(tail, merge)

    def read(self) -> DataFrame:
        return self.factors.read()


def stream_factors(events: DataFrame, table: FactorTable, checkpoint: str, delay: str = "3 days", once: bool = True) -> StreamingQuery:
    """Keeps ``table`` up to date from a stream of events (event_id, ts, user_id, value).

    Events may come out of order by up to ``delay``, and more than once: a repeat goes, and so does an event that
    is later than that. The state is the ids of the last ``delay`` of events. One checkpoint a table.
    """
    timed = events.withColumn("__event_time", F.col("ts").cast("timestamp"))  # a watermark's type
    seen = timed.withWatermark("__event_time", delay).dropDuplicatesWithinWatermark(["event_id"])
    writer = seen.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
