"""Work that stays within bounds: factors by factors, halves of blocks, generations, long windows."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.functions import workers
from factorloom.operators import lineage, overfit, score
from factorloom.plans.compile import evaluate, evaluate_batch
from factorloom.plans.expr import parse


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def long_of(spark, x):
    """An array of (factor, date, symbol), NaN where missing, as rows."""
    f, d, s = (a.ravel() for a in np.indices(x.shape))
    df = pd.DataFrame({"fid": f, "date": pd.Timestamp("2020-01-01") + pd.to_timedelta(d, "D"), "symbol": s, "value": x.ravel()})
    return spark.createDataFrame(df).withColumns({"date": F.to_date("date"), "value": F.nanvl("value", F.lit(None))}).repartition(6)


def ranks(x):
    return np.stack([pd.DataFrame(v).rank(axis=1).to_numpy() for v in x])


def test_correlation_of_many_factors(spark):
    """500 factors: their pairs are added up by task, and no row is made for a pair in a cell."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6, 15)).round(1)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[3] = x[2]
    x[4] = 1.0  # without variance
    got = score.pairwise_rank_correlation(long_of(spark, x))
    assert "array_sort" not in plan_of(got) and "Generate" not in plan_of(got)
    rows = {(r["fid_a"], r["fid_b"]): r["corr"] for r in got.collect()}
    r = ranks(x).reshape(500, -1)
    assert len(rows) == 500 * 499 // 2 and rows[2, 3] == pytest.approx(1) and rows[4, 9] == 0
    for a, b in [(0, 1), (7, 400), (250, 499), (2, 498)]:
        both = ~np.isnan(r[a]) & ~np.isnan(r[b])
        assert rows[a, b] == pytest.approx(np.corrcoef(r[a][both], r[b][both])[0, 1], abs=1e-12)
    kept = score.prune(long_of(spark, x[:6]), {i: -float(i) for i in range(6)}, 0.9)
    assert kept == [0, 1, 2, 4, 5]
    assert score.pairwise_rank_correlation(long_of(spark, x[:2, :1, :2])).first()["corr"] == 0  # two cells


def brute_pbo(x, blocks):
    """Halves one by one on the returns themselves."""
    t, n = x.shape
    ends = [t * i // blocks for i in range(blocks + 1)]
    parts = [x[a:b] for a, b in itertools.pairwise(ends)]
    low = count = 0
    for half in itertools.combinations(range(blocks), blocks // 2):
        own, rest = (np.concatenate([parts[i] for i in range(blocks) if (i in half) == side]) for side in (True, False))
        sharpe = lambda v: np.where(v.std(0, ddof=1) > 1e-15, v.mean(0) / np.maximum(v.std(0, ddof=1), 1e-15), 0)
        best, out = int(np.argmax(sharpe(own))), sharpe(rest)
        rank = (out < out[best]).sum() + ((out == out[best]).sum() + 1) / 2
        low += rank / (n + 1) <= 0.5
        count += 1
    return low / count, count


def returns_of(spark, x):
    t, f = (a.ravel() for a in np.indices(x.shape))
    df = pd.DataFrame({"fid": f, "date": pd.Timestamp("2020-01-01") + pd.to_timedelta(t, "D"), "ret": x.ravel()})
    return spark.createDataFrame(df).withColumn("date", F.to_date("date"))


@pytest.mark.parametrize("blocks", [4, 8])
def test_pbo_by_halves(spark, blocks):
    rng = np.random.default_rng(blocks)
    x = rng.normal(1e-4, 0.01, size=(43, 9)) + np.linspace(0, 4e-3, 9)
    x[:, 4] = 0
    want = brute_pbo(x, blocks)
    got = overfit.pbo(returns_of(spark, x), blocks)
    assert (got["pbo"], got["splits"], got["strategies"]) == (pytest.approx(want[0]), want[1], 9)


def test_pbo_of_many_strategies(spark):
    got = overfit.pbo(returns_of(spark, np.random.default_rng(1).normal(0, 0.01, size=(32, 2000))), 12)
    assert got["splits"] == math.comb(12, 6) and got["strategies"] == 2000 and 0.2 < got["pbo"] < 0.8


def test_halves_in_any_chunks(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    n, mean, m2 = np.full((6, 5), 7.0), rng.normal(size=(6, 5)), rng.random((6, 5))
    bits = [b for b in range(64) if b.bit_count() == 3]
    found = []
    for chunk in (1, 60, 1 << 20):
        monkeypatch.setattr(workers, "CHUNK", chunk)
        batches = (pa.RecordBatch.from_arrays([pa.array(bits[i : i + 8])], ["id"]) for i in range(0, len(bits), 8))
        found.append(next(workers.splits(batches, n, mean, m2)).to_pylist())
    assert found[0] == found[1] == found[2] and found[0][0]["splits"] == 20


def test_ancestors_of_many_generations(spark):
    """500 generations with two parents each: nodes of many paths count once, and the plan stays as it is."""
    rows = [("r", 2 * g + k, g, "crossover", [2 * (g - 1), 2 * (g - 1) + 1] if g else [], "", 0.0) for g in range(500) for k in (0, 1)]
    rows.append(("r", 5000, 499, "clone", [40], "", 0.0))
    deep = spark.createDataFrame(rows, lineage.SCHEMA)
    got = lineage.ancestors(deep, 998, "r")
    assert sorted(r["node"] for r in got.collect()) == sorted([998, *range(998)])
    few = lineage.ancestors(deep, 5000, "r")
    assert sorted(r["node"] for r in few.collect()) == sorted([5000, 40, *range(40)])
    assert len(plan_of(got)) < 400 and len(plan_of(few)) == len(plan_of(got))
    assert lineage.ancestors(deep, -1, "r").collect() == []


def test_long_windows(spark):
    """decay_linear over 5 and 250 rows: as pandas has it, with as many window columns."""
    rng = np.random.default_rng(2)
    x = np.cumsum(rng.normal(size=(2, 600)), axis=1) + 1000
    x[0, 100] = np.nan
    x[1, 50] = np.inf
    df = pd.DataFrame({"symbol": np.repeat(["a", "b"], 600), "date": np.tile(pd.date_range("2020-01-01", periods=600), 2), "close": x.ravel()})
    p = spark.createDataFrame(df).withColumns({"date": F.to_date("date"), "close": F.nanvl("close", F.lit(None))}).cache()
    sizes = {}
    for w in (2, 5, 33, 250):
        out = evaluate(p, parse(f"decay_linear(close, {w})"))
        sizes[w] = plan_of(out).count("windowspecdefinition")
        got = out.toPandas().sort_values(["symbol", "date"])["value"].to_numpy(float).reshape(2, 600)
        weights = np.arange(1, w + 1)
        for own, values in zip(got, x, strict=True):
            want = pd.Series(values).replace([np.inf], np.nan).rolling(w).apply(lambda v: (v * weights).sum() / weights.sum(), raw=True).to_numpy()
            np.testing.assert_allclose(own, want, rtol=1e-7)
    assert sizes[2] == sizes[5] and sizes[33] == sizes[250] <= sizes[5] + 2


def test_cross_sections_of_a_batch_are_dealt_out(spark):
    """However small the rows are when written, few cross-sections (fid, date) are one task's to sort."""
    rows = [(d, s, float((d * 7 + s * 13) % 29)) for d in range(40) for s in range(50)]
    p = spark.createDataFrame(rows, "d int, symbol bigint, close double").select(F.expr("date_add(date'2024-01-01', d)").alias("date"), "symbol", "close")
    long = evaluate_batch(p, [parse("rank(close)"), parse("rank(delta(close, 1))"), parse("close")])
    per_task = long.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("fid", "date").alias("n"))
    assert per_task.agg(F.max("n")).first()[0] <= 12  # of 120
    assert long.count() == 3 * len(rows)
