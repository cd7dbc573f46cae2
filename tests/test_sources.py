"""Bucketed price tables, and providers that executors ask."""

import json
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_analytics import price_rows

from factorloom.operators import panel
from factorloom.sources import files, prices, provider, tables
from factorloom.sources.retry import RetryAfter


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def some(spark, symbols, closes=(1.0, 2.0, 3.0)):
    out = None
    for s in symbols:
        one = price_rows(spark, closes, symbol=s)
        out = one if out is None else out.unionByName(one)
    return out


def test_symbol_windows_need_no_shuffle(spark, tmp_path):
    path = str(tmp_path / "p")
    t = prices.upsert(spark, path, some(spark, "ABCDEFG"), buckets=4)
    adjusted = panel.adjust(t)
    plan = plan_of(adjusted)
    assert "Window" in plan and "Exchange" not in plan
    assert "Exchange" not in plan_of(panel.derive(t))
    assert "Exchange" not in plan_of(t.groupBy("symbol").agg(F.max("date")))
    assert plan_of(panel.panel(t)).count("Exchange hashpartitioning(symbol") < plan_of(panel.panel(some(spark, "AB"))).count("Exchange hashpartitioning(symbol")
    assert adjusted.count() == 21 and t.where("symbol = 'C'").count() == 3


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "p")
    prices.upsert(spark, path, some(spark, "ABCDEFGHIJ"), buckets=8)
    table = prices.price_table(spark, path)
    before = table._files(path)
    assert len(before) == len(set(before.values())) > 2
    touched = table.replace(price_rows(spark, [9.0], symbol="C"), panel.merge)
    after = table._files(path)
    assert len(touched) == 1 and {f for f, b in before.items() if b not in touched} == {f for f, b in after.items() if b not in touched}
    assert set(before) != set(after) and len(after) == len(before)
    assert sorted((r.symbol, r.close) for r in prices.load(spark, path, ["C", "D"]).collect()) == [("C", 2.0), ("C", 3.0), ("C", 9.0), ("D", 1.0), ("D", 2.0), ("D", 3.0)]
    prices.store(price_rows(spark, [5.0], symbol="C"), path)
    assert [r.close for r in prices.load(spark, path, ["C"]).collect()] == [5.0] and prices.load(spark, path).count() == 28
    assert prices.price_table(spark, path, 99).buckets() == 8  # fixed when it was made


@pytest.mark.parametrize("after", [0, 1])
def test_a_write_survives_a_break(spark, tmp_path, monkeypatch, after):
    """The run breaks off while complete files are moved in; old ones of a bucket may be gone by then."""
    path = str(tmp_path / "p")
    prices.upsert(spark, path, some(spark, "ABCD"), buckets=4)
    real, moved = files.move, []

    def breaks(*args):
        if len(moved) == after:
            raise OSError("driver lost")
        moved.append(args)
        real(*args)

    monkeypatch.setattr(tables.files, "move", breaks)
    with pytest.raises(OSError):
        prices.upsert(spark, path, some(spark, "ABCD", [9.0]))
    monkeypatch.setattr(tables.files, "move", real)
    asked = prices.get_or_fetch(spark, path, ["A", "B"], lambda s: pytest.fail("all are there"))  # finishes the write before it reads
    assert sorted((r.symbol, r.close) for r in asked.collect()) == [(s, c) for s in "AB" for c in (2.0, 3.0, 9.0)]
    assert prices.load(spark, path).count() == 12 and not prices.recover(spark, path) and not files.exists(spark, path + "__pending")


def test_read_of_no_table(spark, tmp_path):
    assert prices.load(spark, str(tmp_path / "none")).count() == 0
    assert prices.price_table(spark, str(tmp_path / "none")).replace(prices.load(spark, str(tmp_path / "none")), panel.merge) == set()


def file_provider(folder, log, fail=lambda s: False):
    """Reads a symbol's file, and notes that it was asked."""

    def fetch(symbol, start, end):
        with open(log, "a") as f:
            f.write(symbol + "\n")
        if fail(symbol):
            raise ValueError("no line")
        with open(f"{folder}/{symbol}.json") as f:
            return [r for r in json.load(f) if start <= r["date"] <= end]

    return fetch


def write_symbols(folder, symbols, days=3):
    folder.mkdir()
    for s in symbols:
        rows = [{"date": f"2020-01-{d + 1:02d}", "open": 1, "high": "2.5", "low": 1, "close": d + 1, "volume": "x"} for d in range(days)]
        (folder / f"{s}.json").write_text(json.dumps(rows))


def test_sync_of_many_symbols(spark, tmp_path):
    """2,000 symbols of which 5 % fail: one job asks each once, figures and report agree with what was written."""
    symbols = [f"S{i:04d}" for i in range(2000)]
    write_symbols(tmp_path / "data", symbols)
    log, path = tmp_path / "log", str(tmp_path / "p")
    fetch = file_provider(str(tmp_path / "data"), str(log), lambda s: int(s[1:]) % 20 == 7)
    report = prices.sync(spark, path, symbols, "2020-01-01", "2020-01-03", [("files", fetch)], attempts=1)
    asked = Counter(log.read_text().split())
    assert len(asked) == 2000 and set(asked.values()) == {1}
    assert report.figures == {"rows": 5700, "attempts": 2000, "failures": 100} and prices.load(spark, path).count() == 5700
    status = Counter(r["status"] for r in report.rows)
    assert status == {"fetched": 1900, "failed": 100} and report.rows[7]["error"] == "files: ValueError: no line"
    again = prices.sync(spark, path, symbols, "2020-01-01", "2020-01-03", [("files", fetch)], attempts=1)
    assert Counter(r["status"] for r in again.rows) == {"skipped": 1900, "failed": 100} and again.figures["rows"] == 0
    row = prices.load(spark, path, ["S0001"]).orderBy("date").first()
    assert (row.close, row.high, row.volume, row.split_factor) == (1.0, 2.5, None, 1.0)


def test_plan_of_a_provider_scan_does_not_grow(spark):
    plans = []
    for n in (1, 500):
        df = provider.provider_rows(spark, [(f"S{i}", "2020-01-01", "2020-01-02") for i in range(n)], [("none", lambda s, a, b: [])], partitions=3)
        plans.append(len(df._jdf.queryExecution().optimizedPlan().toString()))
        assert df.rdd.getNumPartitions() == min(3, n) and df.count() == n
    assert plans[0] == plans[1]


def test_sync(spark, tmp_path):
    write_symbols(tmp_path / "a", ["A"], 4)
    write_symbols(tmp_path / "b", ["A", "C"], 4)
    log, path = tmp_path / "log", str(tmp_path / "p")
    first, second = (file_provider(str(tmp_path / x), str(log)) for x in "ab")
    r = prices.sync(spark, path, ["a ", "BAD", "A"], "2020-01-02", "2020-01-03", [("first", first)], attempts=1)
    assert [(x["symbol"], x["status"], x["rows"]) for x in r.rows] == [("A", "fetched", 2), ("BAD", "failed", 0)] and "BAD.json" in r.rows[1]["error"]
    r = prices.sync(spark, path, ["A", "C"], "2020-01-01", "2020-01-04", [("first", first), ("second", second)], attempts=1)
    assert [(x["symbol"], x["status"], x["rows_fetched"], x["rows"], x["provider"]) for x in r.rows] == [("A", "fetched", 2, 4, "first"), ("C", "fetched", 4, 4, "second")]
    assert [a["provider"] for a in r.rows[1]["attempts"]] == ["first", "second"] and r.rows[1]["attempts"][0]["error"]
    r = prices.sync(spark, path, ["A", "C"], "2020-01-01", "2020-01-04", [("first", first)])
    assert [x["status"] for x in r.rows] == ["skipped"] * 2 and r.figures == {"rows": 0, "failures": 0, "attempts": 0}
    assert prices.sync(spark, path, ["A"], "2020-01-01", "2020-01-04", [("first", first)], refresh=True).rows[0]["rows_fetched"] == 4
    assert prices.sync(spark, path, ["Z"], "2021-01-01", "2021-01-04", [("none", lambda s, a, b: [])]).rows[0]["status"] == "failed"


def test_answers_are_tried_again():
    calls, waits = [], []

    def fetch(symbol, start, end):
        calls.append(symbol)
        if len(calls) < 3:
            raise RetryAfter(5)
        return [{"date": "2020-01-01", "close": 1}]

    rows = list(provider.answers(("A", "2020-01-01", "2020-01-02"), [("p", fetch)], 4, sleep=waits.append))
    assert [r["kind"] for r in rows] == ["attempt", "row"] and waits == [5, 5] and rows[0]["rows"] == 1
    rows = list(provider.answers(("A", "2020-01-01", "2020-01-02"), [("p", lambda *a: 1 / 0), ("q", lambda *a: [])], 1))
    assert [(r["provider"], r["rows"], bool(r.get("error"))) for r in rows] == [("p", 0, True), ("q", 0, False)]
