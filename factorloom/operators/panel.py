"""Prices to panels: normalisation, corporate actions, dense grids, derived fields, universes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import by_symbol, nn, quotient, ratio

PRICE_FIELDS = ("open", "high", "low", "close", "volume", "div_cash", "split_factor")
PRICE_SCHEMA = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType()), *(T.StructField(f, T.DoubleType()) for f in PRICE_FIELDS)])


def normalize(raw: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """Raw rows to prices: dates at midnight, numbers or NULL, action columns 0 and 1 if absent, and of the rows
    of one symbol and date the last in order of arrival."""
    have = {c.lower(): c for c in raw.columns}
    missing = [f for f in PRICE_FIELDS[:5] if f not in have]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    number = lambda f: nn(F.col(have[f]).try_cast("double")) if f in have else F.lit({"div_cash": 0.0, "split_factor": 1.0}[f])
    rows = raw.select(F.col("symbol"), F.to_date("date").alias("date"), *(number(f).alias(f) for f in PRICE_FIELDS), F.col(order).alias("__order"))
    last = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("__order")))
    return rows.withColumn("__last", last).where("__last = 1").drop("__last", "__order")


def validate(prices: DataFrame) -> DataFrame:
    """Raises unless the columns are the price schema's, with its types."""
    have = {f.name: f.dataType for f in prices.schema}
    wrong = [f.name for f in PRICE_SCHEMA if f.name != "symbol" and have.get(f.name) != f.dataType]
    if wrong or "symbol" not in have:
        raise ValueError(f"not a price table: {wrong or ['symbol']}")
    return prices


def merge(existing: DataFrame, fetched: DataFrame) -> DataFrame:
    """Both tables' rows; of one symbol and date the fetched row."""
    both = existing.withColumn("__p", F.lit(0)).unionByName(fetched.withColumn("__p", F.lit(1)))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "date").orderBy(F.desc("__p")))).where("__r = 1").drop("__r", "__p")


def adjustment(dividends: bool = True) -> Column:
    """Product over the symbol's later rows of (1 / split) * (1 - dividend / close before); the last row has 1."""
    split = F.when(F.coalesce(F.col("split_factor"), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("split_factor"))
    before = F.lag("close").over(by_symbol())
    cash = F.when((F.col("div_cash") > 0) & (before > 0), 1.0 - F.col("div_cash") / F.nullif(before, F.lit(0.0))).otherwise(F.lit(1.0))
    return 1.0 / split * (cash if dividends else F.lit(1.0))


def adjust(prices: DataFrame) -> DataFrame:
    """Adjusted prices and volume: on the symbol's own rows, before any grid is made."""
    later = by_symbol().rowsBetween(1, Window.unboundedFollowing)
    p = prices.withColumns({"__full": adjustment(), "__split": adjustment(False)})
    p = p.withColumns({"price_adj": F.coalesce(F.product("__full").over(later), F.lit(1.0)), "split_adj": F.coalesce(F.product("__split").over(later), F.lit(1.0))})
    adjusted = {f: F.col(f) * F.col("price_adj") for f in ("open", "high", "low", "close")}
    return p.select("symbol", "date", *(c.alias(f) for f, c in adjusted.items()), ratio(F.col("volume"), F.col("split_adj")).alias("volume"), "price_adj", "split_adj")


def densify(bars: DataFrame, groups: tuple[str, ...] = (), dates: DataFrame | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Every date for every symbol; missing cells are NULL. The grid's dates and symbols may be given.

    Dates are few (a row each) whatever the number of symbols; their table is broadcast by Spark's own
    threshold only.
    """
    own = bars if symbols is None else symbols
    grid = own.select("symbol", *groups).distinct().crossJoin((bars if dates is None else dates).select("date").distinct())
    return grid.join(bars, ["symbol", "date", *groups], "left")


def derive(dense: DataFrame, infinite: bool = True) -> DataFrame:
    """vwap (high + low + close) / 3 and returns over the row before in the grid. A close of 0 before gives an
    infinite return (NULL for 0 over 0), which rolling operators take for missing; without ``infinite`` it is NULL."""
    before = F.lag("close").over(by_symbol())
    over = quotient if infinite else ratio
    return dense.withColumns({"vwap": (F.col("high") + F.col("low") + F.col("close")) / 3.0, "returns": nn(over(F.col("close"), before) - 1.0)})


def panel(prices: DataFrame, start: str | None = None, end: str | None = None, symbols: DataFrame | None = None) -> DataFrame:
    """Adjusted, dense and derived; dates are cut after returns are derived, so the first kept row has one."""
    if symbols is not None:
        prices = prices.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    out = derive(densify(adjust(prices).drop("price_adj", "split_adj")))
    return between(out, start, end)


def between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates from start to end, both included."""
    if start:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    return df.where(F.col("date") <= F.lit(end).cast("date")) if end else df


def event_bars(events: DataFrame) -> DataFrame:
    """Daily bars of an event stream: symbol, open, high, low, close, volume."""
    at = F.struct("ts", "event_id")
    return events.groupBy(F.col("user_id").alias("symbol"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")
    )


def weekly_bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Weekly bars of brands: unit price of line items, by ship date."""
    j = lineitem.join(part, lineitem["l_partkey"] == part["p_partkey"])
    price = F.col("l_extendedprice") / F.col("l_quantity")
    at = F.struct("l_shipdate", "l_orderkey", "l_linenumber", price.alias("p"))
    rows = j.select(F.col("p_brand").alias("symbol"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), price.alias("p"), at.alias("at"), "l_quantity")
    return rows.groupBy("symbol", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("l_quantity").alias("volume"))


# universes: memberships are (universe, symbol, entry, exit); exit NULL is active, exit itself is outside


def members_asof(memberships: DataFrame, date: str, universe: str | None = None) -> DataFrame:
    if universe is not None:
        memberships = memberships.where(F.col("universe") == universe)
        if memberships.isEmpty():
            raise ValueError(f"unknown universe {universe!r}")
    d = F.lit(date).cast("date")
    return memberships.where((F.col("entry") <= d) & (F.col("exit").isNull() | (d < F.col("exit"))))


def restrict_by_date(panel_: DataFrame, memberships: DataFrame) -> DataFrame:
    """Cells whose symbol was a member on their date: an interval join, keyed by symbol."""
    m = memberships.select("symbol", "entry", "exit").distinct()
    inside = (panel_["symbol"] == m["symbol"]) & (m["entry"] <= panel_["date"]) & (m["exit"].isNull() | (panel_["date"] < m["exit"]))
    return panel_.join(m, inside, "left_semi")


def resolve_memberships(expected: DataFrame, prices: DataFrame, stale_days: int = 10) -> DataFrame:
    """Entry: the later of the expected one and the first row. A symbol whose last row is more than
    ``stale_days`` before the newest of all has left on its last row."""
    seen = prices.groupBy("symbol").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    newest = prices.agg(F.max("date").alias("newest"))
    j = expected.join(seen, "symbol").crossJoin(F.broadcast(newest))  # one row
    return j.select("symbol", F.greatest("entry", "first").alias("entry"), F.when(F.datediff("newest", "last") > stale_days, F.col("last")).alias("exit"))


def survivorship(memberships: DataFrame) -> DataFrame:
    """Members in all, active and delisted."""
    gone = F.count(F.when(F.col("exit").isNotNull(), 1))
    return memberships.agg(F.count("*").alias("total"), (F.count("*") - gone).alias("active"), gone.alias("delisted"))


def survivorship_report(name: str, memberships: DataFrame) -> str:
    """The same as Markdown, with every delisted member's entry and exit and every active name; raises no
    alarm where there are delisted ones. Members come in order, part by part."""
    r = survivorship(memberships).first()
    gone = memberships.where("exit is not null").select("symbol", "entry", "exit").orderBy("symbol", "entry", "exit")
    lines = [f"# Survivorship: {name}", "", f"- members: {r['total']}", f"- active: {r['active']}", f"- delisted: {r['delisted']}", "", "## Delisted names", ""]
    if r["delisted"]:
        lines += ["| Symbol | Entry | Exit |", "| --- | --- | --- |"]
        lines += [f"| {x['symbol']} | {x['entry']} | {x['exit']} |" for x in gone.toLocalIterator()]
    else:
        lines.append("- no delisted member: results may be biased")
    active = memberships.where("exit is null").select("symbol").orderBy("symbol")
    names = [x["symbol"] for x in active.toLocalIterator()]
    return "\n".join([*lines, "", "## Active names", "", ", ".join(names) or "none", ""])


def coverage(requested: DataFrame, prices: DataFrame, start: str, end: str) -> DataFrame:
    """For each requested symbol: rows, first, last, whether a head or tail is missing."""
    have = prices.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))
    j = requested.select("symbol").distinct().join(have, "symbol", "left")
    gap = F.col("first").isNull() | (F.col("first") > F.lit(start).cast("date")) | (F.col("last") < F.lit(end).cast("date"))
    return j.select("symbol", F.col("rows").isNotNull().alias("cached"), F.coalesce("rows", F.lit(0)).alias("rows"), "first", "last", gap.alias("needs_sync"))


def sync_plan(covered: DataFrame, start: str, end: str, refresh: bool = False) -> DataFrame:
    """Ranges to fetch: all of it where nothing is there (or on refresh), else the missing head and tail."""
    s, e = F.lit(start).cast("date"), F.lit(end).cast("date")
    whole = F.array(F.struct(s.alias("from"), e.alias("to")))
    head = F.when(F.col("first") > s, F.struct(s.alias("from"), F.date_sub("first", 1).alias("to")))
    tail = F.when(F.col("last") < e, F.struct(F.date_add("last", 1).alias("from"), e.alias("to")))
    ranges = F.when(F.lit(refresh) | F.col("first").isNull(), whole).otherwise(F.array_compact(F.array(head, tail)))
    return covered.select("symbol", F.explode(ranges).alias("r")).select("symbol", F.col("r.from").alias("fetch_from"), F.col("r.to").alias("fetch_to"))


def first_source(sources: list[DataFrame], names: list[str]) -> DataFrame:
    """Rows of several sources; of one symbol and date the row of the first source that has it, with its name."""
    out = None
    for i, (df, name) in enumerate(zip(sources, names, strict=True)):
        one = df.withColumns({"__p": F.lit(i), "source": F.lit(name)})
        out = one if out is None else out.unionByName(one)
    return out.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "date").orderBy("__p"))).where("__r = 1").drop("__r", "__p")
