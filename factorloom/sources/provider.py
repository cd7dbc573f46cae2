"""Providers of daily rows as a Spark data source: executors ask them, a range of symbols to a task.

A provider is ``fetch(symbol, start, end)`` that gives rows as mappings by the price schema's names. It runs in
executors' Python, with retries and its share of the rate limit. What each provider answered is a row too, so a
symbol that fails is told of and holds up no other.
"""

from __future__ import annotations

import sys
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import retry
from .retry import RateLimiter, with_retry

Fetch = Callable[[str, str, str], Iterable[Mapping]]

_NUMBERS = ("open", "high", "low", "close", "volume", "div_cash", "split_factor")
#: Rows of prices (kind ``row``) and of attempts (kind ``attempt``: how many rows a provider gave, or its error).
SCHEMA = "kind string, symbol string, date string, " + ", ".join(f"{c} double" for c in _NUMBERS) + ", ingest_seq bigint, provider string, rows bigint, error string"
_ARROW = pa.schema([
    ("kind", pa.string()), ("symbol", pa.string()), ("date", pa.string()), *((c, pa.float64()) for c in _NUMBERS), ("ingest_seq", pa.int64()), ("provider", pa.string()), ("rows", pa.int64()), ("error", pa.string()),
])


def number(x: object) -> float | None:
    """A number or None, whatever a provider sends."""
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def answers(request: tuple[str, str, str], providers: Sequence[tuple[str, Fetch]], attempts: int, wait: Callable[[], None] = lambda: None, sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Rows of the first provider that has any for the request, after a record of each that was asked."""
    symbol, start, end = request
    for name, fetch in providers:
        record = {"kind": "attempt", "symbol": symbol, "date": start, "provider": name, "rows": 0}

        def ask(fetch: Fetch = fetch) -> list[Mapping]:
            wait()
            return list(fetch(symbol, start, end))

        try:
            found = with_retry(ask, attempts, sleep=sleep)
        except Exception as e:  # noqa: BLE001 - whatever a provider raises is its answer
            yield record | {"error": f"{type(e).__name__}: {e}"}
            continue
        yield record | {"rows": len(found)}
        for i, r in enumerate(found):
            absent = {"div_cash": 0.0, "split_factor": 1.0}
            yield {"kind": "row", "symbol": symbol, "date": str(r["date"]), **{c: number(r[c]) if c in r else absent.get(c) for c in _NUMBERS}, "ingest_seq": i, "provider": name}
        if found:
            return


class _Range(InputPartition):
    def __init__(self, requests: list[tuple[str, str, str]]) -> None:
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, job: dict) -> None:
        self.job = job

    def partitions(self) -> list[_Range]:
        ordered = sorted(self.job["requests"])
        n = max(1, min(self.job["partitions"], len(ordered)))
        return [_Range(ordered[len(ordered) * i // n : len(ordered) * (i + 1) // n]) for i in range(n)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        wait = lambda: None
        if self.job["rate"]:
            calls, period = self.job["rate"]
            share = max(1, self.job["partitions"])  # tasks that may run at once
            wait = RateLimiter(max(1, calls // share), period * max(1.0, share / calls)).acquire
        for r in partition.requests:
            yield pa.RecordBatch.from_pylist(list(answers(r, self.job["providers"], self.job["attempts"], wait)), schema=_ARROW)


class _Source(DataSource):
    job: dict

    @classmethod
    def name(cls) -> str:
        return "symbol_provider"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(self.job)


# Executors need not have this package: what they run of it is sent to them.
for _module in (sys.modules[__name__], retry):
    cloudpickle.register_pickle_by_value(_module)


def provider_rows(spark: SparkSession, requests: Sequence[tuple[str, str, str]], providers: Sequence[tuple[str, Fetch]], partitions: int = 8, attempts: int = 4, rate: tuple[int, float] | None = None) -> DataFrame:
    """Rows and attempts (SCHEMA) for requests of (symbol, start, end).

    One scan, whose plan doesn't grow with the requests; its tasks take ``partitions`` ranges of symbols.
    ``rate`` is (calls, seconds) for all tasks together. The scan asks providers each time that it runs: write
    it before it is used twice.
    """
    job = {"requests": list(requests), "providers": list(providers), "partitions": partitions, "attempts": attempts, "rate": rate}
    spark.dataSource.register(type("SymbolProvider", (_Source,), {"job": job, "__module__": __name__}))
    return spark.read.format("symbol_provider").load()
