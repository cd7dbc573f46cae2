import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorloom.operators import overfit, panel, portfolio, score, splits
from factorloom.plans.compile import Compiler
from factorloom.plans.expr import ExprError, Registry, parse
from factorloom.plans.search import Config, Search
from factorloom.sources import prices
from factorloom.sources.library import Documents, FactorStore, FormulaStore
from factorloom.sources.retry import RateLimiter, RetryAfter, with_retry
from factorloom.streaming.ingest import stream_bars

PRICES = "symbol string, date string, open double, high double, low double, close double, volume double, div_cash double, split_factor double"


def price_rows(spark, closes, splits_=None, divs=None, symbol="A"):
    rows = [(symbol, f"2020-01-{i + 1:02d}", *[float(c)] * 4, 100.0, (divs or {}).get(i, 0.0), (splits_ or {}).get(i, 1.0)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, PRICES).withColumn("date", F.to_date("date"))


def test_split_and_dividend(spark):
    a = panel.adjust(price_rows(spark, [100, 100, 100, 50, 50, 50], {3: 2.0})).orderBy("date").toPandas()
    assert np.allclose(a.close, 50) and a.volume.tolist() == [200, 200, 200, 100, 100, 100]
    a = panel.adjust(price_rows(spark, [100.0, 100, 90, 90], divs={2: 10.0})).orderBy("date").toPandas()
    assert np.allclose(a.close, 90)


def test_normalize(spark):
    raw = spark.createDataFrame([("A", "2020-01-02 10:00:00", "1", "1", "1", "x", "1", 1), ("A", "2020-01-02 09:00:00", "1", "1", "1", "3", "1", 2), ("A", "2020-01-01", "1", "1", "1", "2", None, 3)], "symbol string, date string, Open string, High string, Low string, Close string, Volume string, ingest_seq int")
    n = panel.validate(panel.normalize(raw)).orderBy("date").toPandas()
    assert n.close.tolist() == [2, 3] and n.split_factor.tolist() == [1, 1] and np.isnan(n.volume[0])
    with pytest.raises(ValueError):
        panel.normalize(raw.drop("Close"))


def test_dense_grid_and_members(spark):
    p = price_rows(spark, [1.0, 2, 4]).union(price_rows(spark, [5.0, 5], symbol="B"))
    got = panel.panel(p, start="2020-01-02").orderBy("symbol", "date").toPandas()
    assert len(got) == 4 and got.returns[0] == 1.0 and np.isnan(got.close[3])
    m = spark.sql("select 'u' universe, 'EARLY' symbol, date'2018-01-01' entry, cast(null as date) exit union all select 'u','LATE',date'2020-06-01',null union all select 'u','GONE',date'2015-01-01',date'2019-01-01'")
    assert [r.symbol for r in panel.members_asof(m, "2019-06-01", "u").collect()] == ["EARLY"]
    with pytest.raises(ValueError):
        panel.members_asof(m, "2019-06-01", "none")
    assert "delisted: 1" in panel.survivorship_report("u", m)
    assert prices.sample_universe(spark).count() == 9


def test_survivorship_report_names_all(spark):
    m = spark.sql("select 'u' universe, concat('S', lpad(id, 3, '0')) symbol, date'2015-01-01' entry, if(id < 250, date'2019-01-01', null) exit from range(253)")
    lines = panel.survivorship_report("u", m).split("\n")
    assert [x for x in lines if x.startswith("| S0") or x.startswith("| S1") or x.startswith("| S2")] == [f"| S{i:03d} | 2015-01-01 | 2019-01-01 |" for i in range(250)]
    assert "S250, S251, S252" in lines
    assert "none" in panel.survivorship_report("u", m.where("exit is not null")) and "biased" in panel.survivorship_report("u", m.where("exit is null"))


def toy(spark):
    rng = np.random.default_rng(1)
    rows = [(f"2020-02-{d + 1:02d}", f"S{s}", None if rng.random() < 0.1 else float(rng.normal()), float(rng.normal()), None) for d in range(20) for s in range(10)]
    df = spark.createDataFrame([(d, s, v, r, r) for d, s, v, r, _ in rows], "date string, symbol string, value double, returns double, fwd double").withColumn("date", F.to_date("date"))
    return df, pd.DataFrame([(d, s, v, r) for d, s, v, r, _ in rows], columns=["date", "symbol", "value", "fwd"])


def test_ic(spark):
    df, p = toy(spark)
    got = score.daily_ic(df).orderBy("date").toPandas().ic
    want = [g.dropna().rank()[["value", "fwd"]].corr().iloc[0, 1] for _, g in p[["date", "value", "fwd"]].groupby("date")]
    assert np.allclose(got, want)
    self_ic = score.daily_ic(df.withColumn("fwd", F.col("value"))).toPandas().ic
    assert np.allclose(self_ic, 1)
    assert score.daily_ic(df.withColumn("value", F.lit(1.0))).where("ic is not null").count() == 0
    with pytest.raises(ValueError):
        score.daily_ic(df, method="other")


def test_books(spark):
    df, p = toy(spark)
    for n, legs in ((3, (0, 0)), (5, (2, 1)), (10, (3, 2))):
        one = df.where("date = '2020-02-01'").withColumn("value", F.substring("symbol", 2, 2).cast("double")).where(F.col("value") < n)
        w = portfolio.weigh(one, "quantile").toPandas().weight
        assert ((w > 0).sum(), (w < 0).sum()) == legs
    d = portfolio.backtest_daily(df).toPandas()
    assert np.allclose(d.net, d.gross - d.turnover * 5e-4)
    r = spark.createDataFrame([(1, -0.5), (2, 0.1)], "date int, net double")
    assert portfolio.drawdowns(r).agg(F.min("drawdown")).first()[0] == 0.0
    r = spark.createDataFrame([(1, 0.1), (2, -0.5), (3, 0.0)], "date int, net double")
    assert abs(portfolio.drawdowns(r).agg(F.min("drawdown")).first()[0] + 0.5) < 1e-12
    assert portfolio.compare_schemes(df).count() == 2
    with pytest.raises(ValueError):
        portfolio.weigh(df, "none")


def test_splits(spark):
    line = splits.date_line(spark.sql("select explode(sequence(date'2020-01-01', date'2020-04-09')) date"))
    s = splits.time_split(line)
    assert {r[0]: r[1] for r in s.groupBy("segment").count().collect()} == {"train": 60, "valid": 20, "test": 10}
    frozen = splits.boundaries(s)
    assert splits.apply_boundaries(line.drop("pos"), frozen).count() == 90
    folds = splits.purged_kfold(line, 5, 2, 3).groupBy("fold", "segment").count().toPandas()
    assert folds[folds.segment == "test"]["count"].tolist() == [20] * 5
    assert splits.walk_forward(line, 40, 10).select("fold").distinct().count() == 6
    lock = splits.LockedTestSet(line)
    lock.unlock()
    with pytest.raises(RuntimeError):
        lock.unlock()
    with pytest.raises(ValueError):
        splits.time_split(line.limit(5))


def test_overfitting_guards(spark):
    assert abs(overfit.probabilistic_sharpe(0.0, 100) - 0.5) < 1e-12
    assert overfit.expected_max_sharpe(0.1, 1) == 0 and overfit.expected_max_sharpe(0.1, 100) > overfit.expected_max_sharpe(0.1, 10) > 0
    assert overfit.effective_trials(100, 2, 20, 10) == 800
    rng = np.random.default_rng(0)
    noise = [(int(f), int(d), float(rng.normal())) for f in range(20) for d in range(120)]
    got = overfit.pbo(spark.createDataFrame(noise, "fid int, date int, ret double"), 8)
    assert got["splits"] == 70 and 0 <= got["pbo"] <= 1
    good = [(f, d, r + (3.0 if f == 4 else 0.0)) for f, d, r in noise]
    assert overfit.pbo(spark.createDataFrame(good, "fid int, date int, ret double"), 8)["pbo"] == 0.0
    x = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,)], "x double").agg(*overfit.moments(F.col("x"))).first()
    assert abs(x.skew - pd.Series([1, 2, 4, 9]).skew()) < 1e-9 and abs(x.kurt - 3 - pd.Series([1, 2, 4, 9]).kurt()) < 1e-9


def signal_panel(spark, days=60, names=10):
    rng = np.random.default_rng(11)
    latent = rng.normal(size=(days, names))
    ret = np.r_[np.zeros((1, names)), 0.02 * latent[:-1]] + rng.normal(size=(days, names)) * 0.01
    close = 100 * np.cumprod(1 + ret, 0)
    rows = [(f"S{s}", str(pd.Timestamp("2021-01-01") + pd.Timedelta(days=d))[:10], *([float(close[d, s])] * 4), float(1e6 * np.exp(0.3 * latent[d, s]))) for d in range(days) for s in range(names)]
    df = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, volume double").withColumn("date", F.to_date("date"))
    return panel.derive(df).cache()


def test_search_finds_the_signal_and_resumes(spark):
    p = signal_panel(spark)
    c = Config(population_size=10, generations=2, max_depth=3, max_nodes=8, seed=2)
    s = Search(p, c)
    s.initialize([parse("rank(volume)")])
    saved = s.save()
    best = s.run()
    assert best.ic > 0.5
    again = Search.load(p, saved)
    assert again.run().fitness == best.fitness and again.trials >= len(again.known)
    assert s.lineage(spark).count() == 30 and json.loads(s.save())["generation"] == 2
    parts = splits.time_split(splits.date_line(p), embargo=1)
    v = overfit.judge(p, best.tree, [i.tree for i in s.population][:4], parts.where("segment <> 'test'"), parts.where("segment = 'test'"), s.trials, blocks=6)
    assert v["oos_ic"] > 0.3


def test_prune_and_combine(spark):
    p = score.forward_returns(signal_panel(spark))
    v = Compiler().run(p, {"a": parse("volume"), "b": parse("mul_scalar(volume, 2)"), "c": parse("returns")})
    long = v.select(F.explode(F.array(*(F.struct(F.lit(i).alias("fid"), F.col(c).alias("value")) for i, c in enumerate("abc")))).alias("e"), "date", "symbol").select("e.*", "date", "symbol")
    assert score.prune(long, {0: 3.0, 1: 2.0, 2: 1.0}) == [0, 2]
    mega = score.combine(long, p.select("date", "symbol", "fwd")).join(p.select("date", "symbol", "fwd"), ["date", "symbol"])
    assert score.daily_ic(mega).agg(F.avg("ic")).first()[0] > 0.5


def test_stores(tmp_path, spark):
    reg = Registry()
    forms = FormulaStore(Documents(tmp_path / "f"), reg)
    forms.save("mom", ("series",), "series", parse("delta($0, 3)"))
    forms.save("outer", ("series",), "series", parse("neg(mom($0))", reg))
    new = forms.save("mom", ("series",), "series", parse("delta($0, 5)"))
    assert new == "mom__r2" and forms.impact("mom")["direct"] == ["outer"]
    assert forms.upgrade("mom", "mom__r2") == ["outer__r2"]
    with pytest.raises(ExprError):
        forms.delete("mom")
    fresh = Registry()
    assert FormulaStore(Documents(tmp_path / "f"), fresh).reload()[-1].startswith("outer")
    store = FactorStore(Documents(tmp_path / "x"))
    store.save("Best one", parse("rank(outer(close))", reg), reg, fitness=0.5)
    assert store.load("best one", Registry()) == parse("rank(outer(close))", reg)
    t = prices.get_or_fetch(spark, str(tmp_path / "p"), ["A"], lambda s: price_rows(spark, [1.0, 2]))
    assert t.count() == 2
    assert prices.upsert(spark, str(tmp_path / "p"), price_rows(spark, [7.0])).where("close = 7").count() == 1


def test_streaming(tmp_path, spark):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"symbol": "A", "date": "2020-01-01", "open": 1, "high": 1, "low": 1, "close": c, "volume": 1, "ingest_seq": i}) for i, c in enumerate((1.0, 2.0))))
    q = stream_bars(spark, str(tmp_path / "in"), "symbol string, date string, open double, high double, low double, close double, volume double, ingest_seq int", str(tmp_path / "t"), str(tmp_path / "c"))
    q.awaitTermination()
    assert prices.load(spark, str(tmp_path / "t")).first().close == 2.0


def test_retry():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise RetryAfter(5 if len(tries) == 1 else None)
        return 1

    assert with_retry(call, sleep=waits.append) == 1 and waits == [5, 2.0]
    clock = [0.0]
    lim = RateLimiter(2, 10, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
    for _ in range(3):
        lim.acquire()
    assert clock[0] == 10
