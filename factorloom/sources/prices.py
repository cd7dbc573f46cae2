"""Price tables on disk and landing files of providers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import PRICE_FIELDS, PRICE_SCHEMA, coverage, merge, normalize, resolve_memberships, sync_plan, validate
from . import files
from .provider import Fetch, provider_rows
from .tables import BUCKETS, SymbolTable

#: Landing columns of the two provider formats, by the price schema's names (fixed values).
REST_COLUMNS = {"date": "date", "open": "open", "high": "high", "low": "low", "close": "close", "volume": "volume", "div_cash": "divCash", "split_factor": "splitFactor"}
TABLE_COLUMNS = {"date": "Date", "open": "Open", "high": "High", "low": "Low", "close": "Close", "volume": "Volume", "div_cash": "Dividends", "split_factor": "Stock Splits"}


def price_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> SymbolTable:
    """Prices bucketed by symbol: adjusting, deriving and any window by symbol read them without a shuffle."""
    return SymbolTable(spark, path, PRICE_SCHEMA, buckets)


def load(spark: SparkSession, path: str, symbols: Sequence[str] | None = None) -> DataFrame:
    """Prices; asked for some symbols, only their buckets are read."""
    df = price_table(spark, path).read()
    return df.where(F.col("symbol").isin(list(symbols))) if symbols is not None else df


def store(prices: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes the symbols of ``prices``, replacing all rows of these symbols and no others'."""
    table = price_table(prices.sparkSession, path, buckets)
    table.replace(validate(prices), lambda old, new: old.join(new.select("symbol").distinct(), "symbol", "left_anti").unionByName(new.select(*old.columns)))


def recover(spark: SparkSession, path: str) -> bool:
    """Finishes a write that broke off; True if there was one."""
    return price_table(spark, path).recover()


def upsert(spark: SparkSession, path: str, fetched: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds fetched rows; of one symbol and date the fetched row stays. Only buckets of touched symbols are rewritten."""
    table = price_table(spark, path, buckets)
    table.replace(fetched, merge)
    return table.read()


def get_or_fetch(spark: SparkSession, path: str, symbols: Sequence[str], fetch: Callable[[list[str]], DataFrame]) -> DataFrame:
    """Reads through: fetches symbols that aren't there, stores them, and reads all from disk."""
    recover(spark, path)
    asked = spark.createDataFrame([(s,) for s in symbols], "symbol string")
    missing = [r[0] for r in asked.join(load(spark, path).select("symbol").distinct(), "symbol", "left_anti").collect()]
    if missing:
        store(fetch(sorted(missing)), path)
    return load(spark, path, symbols)


@dataclass
class SyncReport:
    """``rows``: for each symbol status (fetched, skipped, failed), rows fetched and there, first and last date,
    provider, error and all attempts (provider, rows, error). ``figures``: rows and failures of the whole job, as
    they were counted while it wrote."""

    rows: list[dict]
    figures: dict[str, int] = field(default_factory=dict)


def sync(spark: SparkSession, path: str, symbols: Sequence[str], start: str, end: str, providers: Sequence[tuple[str, Fetch]], refresh: bool = False, partitions: int = 8, attempts: int = 4, rate: tuple[int, float] | None = None) -> SyncReport:
    """Fetches what the table lacks of ``symbols`` from ``start`` to ``end`` and merges it.

    One job asks the providers (the first that has rows serves), a range of symbols to a task, and writes what
    they answer beside the table while it is counted; then touched buckets are merged. A symbol that fails is
    reported and holds up no other.
    """
    table = price_table(spark, path)
    table.recover()
    names = list(dict.fromkeys(s.strip().upper() for s in symbols))
    asked = spark.createDataFrame([(s,) for s in names], "symbol string")
    plan = sync_plan(coverage(asked, table.read(), start, end), start, end, refresh)
    requests = [(r["symbol"], str(r["fetch_from"]), str(r["fetch_to"])) for r in plan.collect()]
    figures, tried = {"rows": 0, "failures": 0, "attempts": 0}, {}
    if requests:
        counted = Observation("sync")
        is_row = F.col("kind") == "row"
        answers = provider_rows(spark, requests, providers, partitions, attempts, rate)
        landed = f"{path.rstrip('/')}__fetched"
        answers.observe(counted, F.count(F.when(is_row, 1)).alias("rows"), F.count(F.when(~is_row, 1)).alias("attempts"), F.count("error").alias("failures")).write.mode("overwrite").parquet(landed)
        figures = counted.get
        answers = spark.read.schema(answers.schema).parquet(landed)
        table.replace(normalize(answers.where("kind = 'row'")), merge)
        for r in answers.where("kind = 'attempt'").orderBy("symbol", "date").select("symbol", "provider", "rows", "error").collect():
            tried.setdefault(r["symbol"], []).append({"provider": r["provider"], "rows": r["rows"], "error": r["error"]})
        files.remove(spark, landed)
    out, have = [], {r["symbol"]: r for r in coverage(asked, table.read(), start, end).collect()}
    for s in names:
        own, there = tried.get(s, []), have[s]["rows"]
        served = [a for a in own if a["rows"]]
        errors = [f"{a['provider']}: {a['error'] or 'no rows'}" for a in own if not a["rows"]]
        failed = bool(own) and not served and (not there or any(a["error"] for a in own))
        out.append({
            "symbol": s, "status": "fetched" if served else "failed" if failed else "skipped", "rows_fetched": sum(a["rows"] for a in served), "rows": there, "first": have[s]["first"], "last": have[s]["last"],
            "provider": served[-1]["provider"] if served else None, "error": "; ".join(errors) if failed else None, "attempts": own,
        })
    return SyncReport(out, dict(figures))


def save_universe(memberships: DataFrame, path: str) -> None:
    """Memberships by universe; a universe that is saved again is replaced, others stay."""
    out = memberships.select("universe", "symbol", "entry", "exit")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("universe").parquet(path)


def load_universe(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """universe, symbol, entry, exit; raises for a name that isn't there."""
    df = spark.read.schema("symbol string, entry date, exit date, universe string").parquet(path).select("universe", "symbol", "entry", "exit")
    if name is None:
        return df
    df = df.where(F.col("universe") == name)
    if df.isEmpty():
        raise ValueError(f"unknown universe {name!r}")
    return df


def universes(spark: SparkSession, path: str) -> DataFrame:
    """Every universe with its members in all and active; none if there is no table."""
    if not files.exists(spark, path):
        return spark.createDataFrame([], "universe string, members bigint, active bigint")
    return load_universe(spark, path).groupBy("universe").agg(F.count("*").alias("members"), F.count(F.when(F.col("exit").isNull(), 1)).alias("active"))


def delete_universe(spark: SparkSession, path: str, name: str) -> None:
    """Takes a universe away, and no other; raises for a name that isn't there."""
    load_universe(spark, path, name)
    for folder in files.names(spark, path):
        if unquote(folder) == f"universe={name}":
            files.remove(spark, f"{path.rstrip('/')}/{folder}")


def edit_universe(spark: SparkSession, path: str, name: str, add: DataFrame | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Adds members (symbol, entry, exit), whose intervals replace those of the same symbols, and takes some out."""
    old = load_universe(spark, path, name)
    kept = old.where(~F.col("symbol").isin(list(drop))) if drop else old
    if add is not None:
        kept = kept.join(add.select("symbol"), "symbol", "left_anti").select(old.columns).unionByName(add.select(F.lit(name).alias("universe"), "symbol", "entry", "exit"))
    rows = [tuple(r) for r in kept.collect()]  # one universe's members; read before its files are replaced
    save_universe(spark.createDataFrame(rows, "universe string, symbol string, entry date, exit date"), path)
    return load_universe(spark, path, name)


def sync_memberships(spark: SparkSession, universes_path: str, name: str, prices_path: str, stale_days: int = 10) -> DataFrame:
    """Sets a universe's entries and exits by its members' prices; members without prices stay as they are."""
    old = load_universe(spark, universes_path, name)
    found = resolve_memberships(old.select("symbol", "entry"), load(spark, prices_path), stale_days)
    new = old.join(found.select("symbol", F.col("entry").alias("__entry"), F.col("exit").alias("__exit"), F.lit(True).alias("__found")), "symbol", "left")
    by_prices = lambda c: F.when(F.col("__found"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)
    return edit_universe(spark, universes_path, name, new.select("symbol", by_prices("entry"), by_prices("exit")))


def landing(raw: DataFrame, columns: dict[str, str], symbol: str | None = None) -> DataFrame:
    """A provider's rows under the schema's names, with an order of arrival; a split of 0 means none."""
    have = set(raw.columns)
    picked = [F.col(f"`{src}`").alias(name) for name, src in columns.items() if src in have]
    sym = F.lit(symbol) if symbol is not None else F.col("symbol")
    out = raw.select(sym.alias("symbol"), *picked, (F.col("ingest_seq") if "ingest_seq" in have else F.monotonically_increasing_id()).alias("ingest_seq"))
    if "split_factor" in out.columns:
        out = out.withColumn("split_factor", F.when(F.col("split_factor") == 0, 1.0).otherwise(F.col("split_factor")))
    return out


def read_rest_json(spark: SparkSession, path: str) -> DataFrame:
    return landing(spark.read.json(path), REST_COLUMNS)


def read_table_csv(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    return landing(spark.read.option("header", True).csv(path), TABLE_COLUMNS, symbol)


#: Members of the sample universe with entry and exit (fixed values).
SAMPLE_MEMBERS = (
    ("AAPL", "2000-01-03", None), ("MSFT", "2000-01-03", None), ("AMZN", "2000-01-03", None), ("JPM", "2000-01-03", None), ("XOM", "2000-01-03", None),
    ("NVDA", "2000-01-03", None), ("GOOGL", "2004-08-19", None), ("META", "2012-05-18", None), ("LEH", "2000-01-03", "2008-09-15"),
)


def sample_universe(spark: SparkSession, name: str = "sp500-lite") -> DataFrame:
    """A small universe with one member that left: universe, symbol, entry, exit."""
    df = spark.createDataFrame([(name, *m) for m in SAMPLE_MEMBERS], "universe string, symbol string, entry string, exit string")
    return df.select("universe", "symbol", F.to_date("entry").alias("entry"), F.to_date("exit").alias("exit"))
