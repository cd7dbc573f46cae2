"""Stores, sync, universes, jobs and records, and the guards against plain numpy."""

import itertools
import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_analytics import price_rows, signal_panel

from factorloom.operators import lineage, overfit, panel, score
from factorloom.plans.compile import evaluate
from factorloom.plans.expr import CATEGORIES, ExprError, Registry, parse
from factorloom.plans.search import Config, Search
from factorloom.plans.sessions import Jobs, Session, export_run, run_search, validate_export
from factorloom.sources import files, prices
from factorloom.sources.library import Categories, Documents, FactorStore, FormulaStore, Settings, Workspaces, clear, usage


def test_returns_after_a_close_of_zero(spark):
    p = panel.derive(panel.densify(price_rows(spark, [0.0, 1.0, 0.0, 0.0, 2.0]))).orderBy("date")
    assert [r.returns for r in p.collect()] == [None, math.inf, -1.0, None, math.inf]
    got = evaluate(p, parse("ts_mean(returns, 2)")).orderBy("date").collect()
    assert [r.value for r in got] == [None] * 5  # infinities are missing to rolling operators
    assert [r.value for r in evaluate(p, parse("neg(returns)")).orderBy("date").collect()] == [None, -math.inf, 1.0, None, -math.inf]


def test_provider_files(spark, tmp_path):
    (tmp_path / "rest.json").write_text(json.dumps({"symbol": "A", "date": "2020-01-02T00:00:00.000Z", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 5, "divCash": 0.5, "splitFactor": 2.0}))
    (tmp_path / "table.csv").write_text("Date,Open,High,Low,Close,Volume,Dividends,Stock Splits\n2020-01-02,1,2,1,2,5,0,0\n")
    r = panel.normalize(prices.read_rest_json(spark, str(tmp_path / "rest.json"))).first()
    assert (r.symbol, str(r.date), r.close, r.div_cash, r.split_factor) == ("A", "2020-01-02", 2.0, 0.5, 2.0)
    r = panel.normalize(prices.read_table_csv(spark, str(tmp_path / "table.csv"), "B")).first()
    assert (r.symbol, str(r.date), r.split_factor) == ("B", "2020-01-02", 1.0)


def test_universes(spark, tmp_path):
    path = str(tmp_path / "u")
    prices.save_universe(prices.sample_universe(spark), path)
    prices.save_universe(spark.sql("select 'own' universe, 'A' symbol, date'2020-01-01' entry, cast(null as date) exit"), path)
    assert prices.load_universe(spark, path).count() == 10
    add = spark.sql("select 'B' symbol, date'2020-01-01' entry, date'2021-01-01' exit union all select 'A', date'2019-01-01', null")
    own = prices.edit_universe(spark, path, "own", add).orderBy("symbol").collect()
    assert [(r.symbol, str(r.entry), str(r.exit)) for r in own] == [("A", "2019-01-01", "None"), ("B", "2020-01-01", "2021-01-01")]
    assert prices.edit_universe(spark, path, "own", drop=["A"]).count() == 1 and prices.load_universe(spark, path, "sp500-lite").count() == 9
    with pytest.raises(ValueError):
        prices.load_universe(spark, path, "none")
    assert sorted((r.universe, r.members, r.active) for r in prices.universes(spark, path).collect()) == [("own", 1, 0), ("sp500-lite", 9, 8)]
    prices.delete_universe(spark, path, "own")
    assert [r.universe for r in prices.universes(spark, path).collect()] == ["sp500-lite"]
    with pytest.raises(ValueError):
        prices.delete_universe(spark, path, "own")


def test_families_categories_and_factors(tmp_path):
    reg = Registry()
    forms = FormulaStore(Documents(tmp_path / "formulas"), reg)
    forms.save("mom", ("series",), "series", parse("delta($0, 3)"))
    forms.save("use__rx", ("series",), "series", parse("neg(mom($0))", reg))
    forms.save("other", ("series",), "series", parse("abs(mom($0))", reg))
    new = forms.save("mom", ("series",), "series", parse("delta($0, 5)"))
    assert forms.upgrade("mom", new, only={"use__rx"}) == ["use__rx__r2"] and "use" not in forms.documents.keys()
    assert forms.validate("neg($0)", ("series",))["valid"] and not forms.validate("neg(none)")["valid"]
    sessions = Documents(tmp_path / "sessions")
    sessions.put("s", {"operators": ["other"]})
    assert forms.impact("mom", sessions=sessions) == {"direct": ["other", "use__rx"], "transitive": [], "factors": [], "sessions": ["s"]}
    with pytest.raises(ExprError):
        forms.delete("other", sessions=sessions)

    cats = Categories(Documents(tmp_path / "meta"))
    cats.add("Mine")
    cats.assign("rank", "mine", reg)
    fresh = Registry()
    assert Categories(Documents(tmp_path / "meta")).apply(fresh)["order"] == [*CATEGORIES, "mine"] and fresh.category("rank") == "mine" and "rank" not in fresh.names({"cross_sectional"})
    assert fresh.counts()["mine"] == 1
    cats.remove("mine")
    assert cats.apply(fresh)["overrides"] == {} and fresh.category("rank") == "cross_sectional"
    for bad in (lambda: cats.add("mine!!" * 0), lambda: cats.remove("data"), lambda: cats.assign("rank", "none", reg)):
        with pytest.raises(ValueError):
            bad()
    assert reg.clear() == 5 and not reg.macros

    store = FactorStore(Documents(tmp_path / "factors"))
    store.save("one", parse("close"), reg, fitness=0.1, saved_at="2020-01-01")
    store.save("two", parse("open"), reg, fitness=0.9, saved_at="2021-01-01")
    assert store.update("one", "uno", "a note")["notes"] == "a note" and store.update("none", "x") is None
    assert [d["name"] for d in store.list()] == ["two", "uno"]
    with pytest.raises(ValueError):
        store.update("uno", "two")
    assert usage(tmp_path)["factors"]["files"] == 2
    clear(tmp_path, "factors")
    assert usage(tmp_path)["factors"] == {"files": 0, "bytes": 0} and store.list() == []
    with pytest.raises(ValueError):
        clear(tmp_path, "all")


def config(**k):
    return Config(population_size=4, generations=1, max_depth=3, max_nodes=8, seed=3, **k)


def test_records_jobs_and_sessions(spark, tmp_path):
    p = signal_panel(spark)
    jobs, gate = Jobs(), threading.Event()

    def call(stop, observe):
        return run_search(p, config(), seeds=[parse("rank(volume)")], embargo=1, stop=stop, observe=observe)

    jobs.submit("run", call)
    report, search = jobs.result("run", 300)
    state = jobs.poll("run")
    assert state["state"] == "done" and [h["generation"] for h in state["history"]] == [0, 1] and state["progress"]["target"] == 1
    jobs.submit("bad", lambda stop, observe: 1 // 0)
    jobs.submit("slow", lambda stop, observe: (gate.wait(60), stop())[1])
    with pytest.raises(RuntimeError):
        jobs.submit("slow", lambda stop, observe: None)
    assert jobs.cancel("slow") and not jobs.cancel("none")
    gate.set()
    assert jobs.result("slow", 60) is True
    with pytest.raises(ZeroDivisionError):
        jobs.result("bad", 60)
    assert jobs.poll("bad")["state"] == "failed"
    assert validate_export(export_run(report, search))["report"]["best"] == report["best"]
    with pytest.raises(ValueError):
        validate_export(json.dumps({"report": {}}))

    path = str(tmp_path / "lineage")
    lineage.save(search.lineage(spark), path)
    lineage.save(search.lineage(spark).withColumn("run_id", F.lit("again")), path)
    rows = lineage.load(spark, path)
    assert rows.count() == 16 and rows.schema == search.lineage(spark).schema
    assert [len(g) for g in lineage.replay(rows, "run")] == [4, 4] and lineage.replay(rows, "run")[1] == [r[5] for r in search.records[4:]]
    assert lineage.current(rows, "again") == [q.id for q in search.population] and lineage.current(rows, "run", 0) == [0, 1, 2, 3]
    assert {r[3].split("+")[0] for r in search.records} <= {"seed", "init", "elite", "crossover", "reproduction"}

    session, own = Session.start("s", Documents(tmp_path / "sessions"), p, embargo=1), config()
    for i in range(3):
        session.segment(p, own)
        assert Search.load(p, session.checkpoint).generation == i + 1
    assert own.generations == 1


def test_pbo_against_plain_numpy(spark):
    """All 12,870 halves of 16 blocks, Sharpe ratios from the daily returns themselves."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(100, 5))
    m[:, 3] += 0.15
    m[7, 2] = np.nan
    rows = [(f, d, None if np.isnan(m[d, f]) else float(m[d, f])) for f in range(5) for d in range(100)]
    got = overfit.pbo(spark.createDataFrame(rows, "fid int, date int, ret double"))
    x, blocks = np.nan_to_num(m), [range(int(100 * i / 16), int(100 * (i + 1) / 16)) for i in range(16)]
    below = []
    for half in itertools.combinations(range(16), 8):
        a = x[[d for b in half for d in blocks[b]]]
        b = x[[d for c in range(16) if c not in half for d in blocks[c]]]
        best = (a.mean(0) / a.std(0, ddof=1)).argmax()
        out = b.mean(0) / b.std(0, ddof=1)
        rank = (out < out[best]).sum() + ((out == out[best]).sum() + 1) / 2
        below.append(math.log(rank / 6 / (1 - rank / 6)) <= 0)
    assert got["splits"] == 12_870 and abs(got["pbo"] - np.mean(below)) < 1e-12


def test_deflated_sharpe():
    normal = overfit._NORMAL
    want = normal.cdf(0.1 * math.sqrt(99) / math.sqrt(1 - 0.2 * 0.1 + (4 - 1) / 4 * 0.01))
    assert abs(overfit.probabilistic_sharpe(0.1, 100, 0.2, 4.0) - want) < 1e-12
    top = math.sqrt(0.02) * ((1 - 0.5772156649015329) * normal.inv_cdf(1 - 1 / 50) + 0.5772156649015329 * normal.inv_cdf(1 - 1 / (50 * math.e)))
    assert abs(overfit.expected_max_sharpe(0.02, 50) - top) < 1e-12
    assert overfit.deflated_sharpe(0.1, 100, 0.2, 4.0, 0.02, 50) == overfit.probabilistic_sharpe(0.1, 100, 0.2, 4.0, overfit.expected_max_sharpe(0.02, 50))


def test_combined_trees(spark):
    p = signal_panel(spark)
    mega = score.combine_trees(p, [parse("volume"), parse("rank(returns)")], "2021-02-10")
    ic = score.daily_ic(mega.join(score.forward_returns(p).select("date", "symbol", "fwd"), ["date", "symbol"]))
    assert mega.count() == 600 and ic.agg(F.avg("ic")).first()[0] > 0.5


def test_settings_and_workspaces(tmp_path):
    s = Settings(Documents(tmp_path / "meta"))
    assert s.show() == {"factors_dir": "factors", "provider_key_set": False} and s.provider_key() is None
    assert "secret" not in str(s.update({"provider_key": " secret "})) and s.provider_key() == "secret"
    assert s.update({"factors_dir": str(tmp_path / "f")}) == {"factors_dir": str(tmp_path / "f"), "provider_key_set": True} and (tmp_path / "f").is_dir()
    (tmp_path / "file").write_text("")
    for bad in ({"factors_dir": str(tmp_path / "file" / "x")}, {"other": "x"}, {"provider_key": 3}):
        with pytest.raises(ValueError):
            s.update(bad)
    assert s.update({"provider_key": ""})["provider_key_set"] is False and s.show()["factors_dir"] == str(tmp_path / "f")

    w = Workspaces(Documents(tmp_path / "w"))
    assert w.save({"name": "First one", "version": 1, "savedAt": "2024-01-01", "ui": {"tab": 2}}) == "first_one"
    w.save({"name": "Second", "version": 2, "savedAt": "2024-02-01", "run": {"best": "close"}})
    assert [(x["id"], x["hasRun"]) for x in w.summaries()] == [("second", True), ("first_one", False)] and w.get("First one")["ui"] == {"tab": 2}
    for bad in ({"name": "x", "version": 0, "savedAt": "a"}, {"name": "x", "savedAt": "a"}, {"name": "x", "version": 1, "savedAt": "a", "ui": []}, {"name": "x", "version": 1, "savedAt": "a", "what": 1}):
        with pytest.raises(ValueError):
            w.save(bad)
    assert w.delete("second") and not w.delete("second")
    with pytest.raises(KeyError):
        w.get("second")


def test_membership_dates_by_prices(spark, tmp_path):
    u, p = str(tmp_path / "u"), str(tmp_path / "p")
    prices.save_universe(spark.sql("select 'own' universe, explode(array('A', 'B', 'C')) symbol, date'2020-01-02' entry, cast(null as date) exit"), u)
    late = price_rows(spark, [1.0], symbol="B").withColumn("date", F.to_date(F.lit("2020-02-01")))
    prices.upsert(spark, p, price_rows(spark, [1.0, 2.0], symbol="A").unionByName(late), buckets=2)
    got = {r.symbol: (str(r.entry), str(r.exit)) for r in prices.sync_memberships(spark, u, "own", p).collect()}
    assert got == {"A": ("2020-01-02", "2020-01-02"), "B": ("2020-02-01", "None"), "C": ("2020-01-02", "None")}


def test_usage_of_shared_storage(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "prices" / "t"))
    assert 0 < usage(tmp_path, spark)["prices"]["bytes"] <= usage(tmp_path)["prices"]["bytes"]
    clear(str(tmp_path), "prices", spark)
    assert usage(f"file://{tmp_path}", spark)["prices"] == {"files": 0, "bytes": 0}
