import json

import pytest

from factorloom.plans.expr import parse
from factorloom.plans.search import Config
from factorloom.plans.sessions import Session, catalogue, export_run, net_returns, run_search
from factorloom.sources.library import Documents
from test_analytics import signal_panel


def config(**k):
    return Config(population_size=6, generations=1, max_depth=3, max_nodes=8, seed=3, **k)


def test_run_and_export(spark):
    p = signal_panel(spark)
    report, search = run_search(p, config(), seeds=[parse("rank(volume)")], embargo=1)
    assert report["oos_ic"] > 0.3 and 0 <= report["pbo"] <= 1 and report["trials"] >= 1
    assert len(json.loads(export_run(report, search))["lineage"]) == 12
    assert net_returns(p, parse("rank(volume)")).count() == 60
    with pytest.raises(ValueError):
        export_run({}, search)
    assert len(catalogue()) == 33


def test_session_goes_on(spark, tmp_path):
    p = signal_panel(spark)
    s = Session.start("first", Documents(tmp_path), p, embargo=1)
    a = s.segment(p, config(), seeds=[parse("rank(volume)")])
    t = Session.load("first", Documents(tmp_path))
    b = t.segment(p, config(parsimony=0.0))
    assert a["warning"] is None and b["warning"] and b["test_reads"] == 2 and b["raw_trials"] > a["raw_trials"]
    t.running = True
    with pytest.raises(RuntimeError):
        t.segment(p, config())
