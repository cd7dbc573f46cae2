import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
SOME = ["daily_ic_spearman", "backtest_summary", "adjust_prices", "members_interval", "lineage_ancestors", "op_decay_linear", "sync_plan", "combine_signals", "stored_prices", "neutralize_both", "backtest_on_dates"]


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert sum(n.startswith("op_") for n in entry.queries()) == 35


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "nation", "customer", "lineitem", "part"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda df: sorted(tuple("" if x is None or x != x else f"{x:.5f}" if isinstance(x, float) else str(x)[:10] for x in r) for r in df[columns].itertuples(index=False))
    assert show(got) == show(want)
