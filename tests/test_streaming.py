"""Factor tables of a stream against those of one batch."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from factorloom.operators import panel
from factorloom.plans.compile import evaluate
from factorloom.plans.expr import parse
from factorloom.streaming.factors import FactorTable, across, lookback, stream_factors

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"
FORMULAS = {"mean": "ts_mean(close, 3)", "change": "delta(returns, 2)", "no": "not_(gt(open, delay(close, 1)))"}
RANKED = {"r": "rank(ts_mean(volume, 2))", "top": "ts_max(zscore(close), 2)"}


def made(days=9, seed=1):
    """Events of six symbols: one comes late, one is seen twice only, some days have none."""
    rng, out = random.Random(seed), []
    for d in range(days):
        for s in range(6):
            if d == 4 or (s == 4 and d < 6) or (s == 5 and d not in (1, 7)) or rng.random() < 0.2:
                continue
            for _ in range(rng.randrange(1, 4)):
                ts = dt.datetime(2020, 1, 1) + dt.timedelta(days=d, seconds=rng.randrange(86_400))
                out.append((len(out), ts, s, float(rng.randrange(1, 9))))
    return out


def whole(spark, rows, formulas):
    bars = panel.event_bars(spark.createDataFrame(rows, EVENTS))
    p = panel.derive(panel.densify(bars)).cache()
    found = {}
    for k, f in formulas.items():
        for r in evaluate(p, parse(f)).collect():
            found.setdefault((r["symbol"], r["date"]), {})[k] = r["value"]
    return found


def held(table, formulas):
    return {(r["symbol"], r["date"]): {k: r[k] for k in formulas} for r in table.read().collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for key in a:
        for k in a[key]:
            x, y = a[key][k], b[key][k]
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-9)), (key, k, x, y)


@pytest.mark.parametrize("formulas", [FORMULAS, RANKED])
def test_batches_in_any_order(spark, tmp_path, formulas):
    rows = made()
    late = [r for r in rows if r[1].day in (2, 5)]
    rest = [r for r in rows if r not in late]
    batches = [rest[: len(rest) // 2], late[::2], rest[len(rest) // 2 :], late[1::2]]
    table = FactorTable(spark, str(tmp_path / "t"), {k: parse(f) for k, f in formulas.items()}, buckets=3)
    seen = []
    for i, b in enumerate(batches):
        table.apply(spark.createDataFrame(b, EVENTS), i)
        seen += b
        if i in (1, 3):
            same(held(table, formulas), whole(spark, seen, formulas))
    table.apply(spark.createDataFrame([], EVENTS), 4)
    table.apply(spark.createDataFrame(batches[3], EVENTS), 3)  # a batch that is run again
    same(held(table, formulas), whole(spark, rows, formulas))


def test_a_batch_that_broke_off(spark, tmp_path, monkeypatch):
    rows = made(6)
    formulas = {"mean": FORMULAS["mean"]}
    table = FactorTable(spark, str(tmp_path / "t"), {k: parse(f) for k, f in formulas.items()}, buckets=3)
    table.apply(spark.createDataFrame(rows[:20], EVENTS), 0)
    again = FactorTable._recompute

    def broken(*_):
        raise OSError("driver lost")

    monkeypatch.setattr(FactorTable, "_recompute", broken)
    with pytest.raises(OSError):
        table.apply(spark.createDataFrame(rows[20:], EVENTS), 1)  # bars and dates are in place
    monkeypatch.setattr(FactorTable, "_recompute", again)
    table.apply(spark.createDataFrame(rows[20:], EVENTS), 1)
    same(held(table, formulas), whole(spark, rows, formulas))


def test_only_what_changed_is_rewritten(spark, tmp_path):
    rows = made()
    formulas = {"mean": FORMULAS["mean"]}
    table = FactorTable(spark, str(tmp_path / "t"), {k: parse(f) for k, f in formulas.items()}, buckets=4)
    table.apply(spark.createDataFrame(rows, EVENTS), 0)
    before = table.factors._files(table.factors.path)
    one = [(1000, rows[-1][1], rows[-1][2], 5.0)]
    table.apply(spark.createDataFrame(one, EVENTS), 1)
    after = table.factors._files(table.factors.path)
    assert len(set(before) - set(after)) == 1  # the bucket of the one symbol
    same(held(table, formulas), whole(spark, rows + one, formulas))


def test_stream_of_late_and_repeated_events(spark, tmp_path):
    """Repeats in the same and in later batches go, the query is taken up from its checkpoint, and the state is
    that of the last days."""
    rows = made(30, seed=4)
    order = sorted(rows, key=lambda r: (r[1] + dt.timedelta(hours=r[0] * 7 % 36), r[0]))
    n = len(order) // 4
    slices = [order[:n] + order[:5], order[n : 2 * n] + order[n - 9 : n], order[2 * n : 3 * n] + order[:9], order[3 * n :]]
    formulas = {"mean": FORMULAS["mean"]}
    table = FactorTable(spark, str(tmp_path / "t"), {k: parse(f) for k, f in formulas.items()}, buckets=3)
    state = []
    for i, b in enumerate(slices):
        spark.createDataFrame(b, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = stream_factors(spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in")), table, str(tmp_path / "c"), "2 days")
        q.awaitTermination()
        state.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    same(held(table, formulas), whole(spark, rows, formulas))
    assert 0 < state[-1] < len(rows) / 3
    total = table.bars.read().agg(F.sum("volume")).first()[0]
    assert total == len(rows)


def test_lookback():
    assert [lookback(parse(f)) for f in ("close", "returns", "ts_mean(returns, 3)", "delta(delay(close, 2), 3)", "add(ts_sum(close, 5), vwap)", "rank(ts_rank(volume, 4))")] == [0, 1, 3, 5, 4, 3]
    assert across(parse("neg(rank(close))")) and not across(parse("ts_mean(close, 2)"))
