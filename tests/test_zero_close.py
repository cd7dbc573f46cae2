"""Queries against their SQL where a close of 0 comes before another, and where rounding meets a tie."""

import datetime

import duckdb
import pytest

import __spark_entry__ as entry

SOME = [
    "backtest_daily", "backtest_on_dates", "backtest_summary", "combine_signals", "compare_schemes", "daily_ic_pearson", "drawdown", "forward_returns", "judge", "long_short_returns", "moments",
    "net_returns", "op_abs", "op_div", "op_log", "op_returns", "op_scale", "panel_dense", "pbo", "score_batch", "stream_factors", "tree_returns",
]


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """30 days of 12 users, of whom one has a value of 0 on five days and values beside it."""
    path = tmp_path_factory.mktemp("zero")
    start, rows = datetime.datetime(2024, 1, 1), []
    for day in range(30):
        for user in range(12):
            for k in range(1 + (day * 5 + user * 7) % 4):
                value = 0.0 if user == 4 and day % 6 == 3 else round(20.0 + user + (day * 37 + user * 61 + k * 13) % 101 / 7, 2)
                rows.append((len(rows), start + datetime.timedelta(days=day, hours=k, minutes=user), user, value))
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").coalesce(1).write.parquet(str(path / "events.parquet"))
    return str(path)


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, events, name):
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{events}/events.parquet/*.parquet'")
    got, want = entry.queries()[name](spark, events).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda df: sorted(tuple("" if x is None or x != x else f"{round(x, 5) + 0.0:.5f}" if isinstance(x, float) else str(x)[:10] for x in r) for r in df[columns].itertuples(index=False))
    assert show(got) == show(want)


def test_ties_of_rounding(spark, tmp_path):
    """67.98 / (67.98 / 53.9 - 1) is 260.2359375, and times a million in floating point below the tie."""
    rows = [(0, datetime.datetime(2024, 1, 1), 1, 53.9), (1, datetime.datetime(2024, 1, 2), 1, 67.98)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got = [r.value for r in entry.queries()["op_div"](spark, str(tmp_path)).orderBy("date").collect()]
    assert got == con.sql(entry.oracle_sql()["op_div"] + " ORDER BY date").df()["value"].astype(object).where(lambda x: x.notna(), None).tolist() == [None, 260.235937]
