"""Streaming ingest of price rows: an extension, as batch sync is all that the panel needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.panel import normalize
from ..sources.prices import upsert


def stream_bars(spark: SparkSession, landing: str, schema: str, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Landing JSON files to the price table. Each micro-batch keeps the last arrival of a symbol and date and
    is merged by key, so a batch that is run again after a failure changes nothing."""
    raw = spark.readStream.schema(schema).json(landing)

    def merge_batch(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(spark, table, normalize(batch))

    writer = raw.writeStream.foreachBatch(merge_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
