"""Searches that are stopped, taken up and share scores."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F
from test_analytics import signal_panel

from factorloom.plans import search as search_module
from factorloom.plans.expr import Registry, parse
from factorloom.plans.search import Config, Generator, Individual, ScoreMemo, Search, tree_key
from factorloom.plans.sessions import Jobs, Session
from factorloom.sources.library import Documents


def config(**k):
    return Config(**{"population_size": 5, "generations": 1, "max_depth": 3, "max_nodes": 9, "seed": 5, **k})


@pytest.fixture
def counted(monkeypatch):
    """Trees that were scored."""
    seen, real = [], search_module.score_batch

    def count(panel, trees, *args):
        seen.extend(tree_key(t) for t in trees)
        return real(panel, trees, *args)

    monkeypatch.setattr(search_module, "score_batch", count)
    return seen


def test_a_run_taken_up_scores_no_known_tree(spark, tmp_path, counted):
    p, memo = signal_panel(spark).cache(), ScoreMemo(spark, str(tmp_path / "memo"))
    first = Search(p, config(), run_id="a", memo=memo)
    first.run([parse("rank(volume)")])
    assert len(counted) == len(set(counted)) == first.trials == len(first.known)
    state, before = first.save(), first.trials
    again = Search.load(p, state, config=config(generations=2), memo=ScoreMemo(spark, str(tmp_path / "memo")))
    assert again.trials == before and again.known == first.known
    counted.clear()
    again.score([q.tree for q in again.population])
    assert counted == [] and again.trials == before
    again.run()
    assert again.generation == 2 and not set(counted) & set(first.known) and again.trials == before + len(counted)
    counted.clear()
    other = Search(p, config(seed=5), run_id="b", memo=memo)  # another run that tries the same trees
    other.run([parse("rank(volume)")])
    assert counted == [] and other.trials == before and [q.fitness for q in other.population] == [q.fitness for q in first.population]
    changed = Search(p, config(parsimony=0.0), run_id="c", memo=memo)  # other scoring: nothing is known
    changed.initialize()
    assert len(counted) == changed.trials
    part = Search(p.where(F.col("date") > "2021-01-05"), config(), run_id="d", memo=memo)
    assert part.scope() != first.scope()


def test_trials_of_a_session_grow_by_new_trees_only(spark, tmp_path, counted):
    p, memo = signal_panel(spark), ScoreMemo(spark, str(tmp_path / "memo"))
    s = Session.start("s", Documents(tmp_path / "d"), p, embargo=1)
    totals = [s.segment(p, config(), memo=memo)["raw_trials"] for _ in range(2)]
    assert len(counted) == len(set(counted)) == totals[1] >= totals[0]
    t = Session.load("s", Documents(tmp_path / "d"))
    third = t.segment(p, config(parsimony=0.0), memo=memo)["raw_trials"]  # scored anew under the new rule
    assert third > totals[1]


def test_a_stop_ends_the_running_generation(spark, tmp_path):
    p = signal_panel(spark).cache()
    run, started = Search(p, config(generations=50)), threading.Event()
    whole = search_module.score_batch

    def slow(panel, trees, *args):
        if run.generation < 1 or not run.population:
            return whole(panel, trees, *args)
        started.set()
        hold = F.udf(lambda x: time.sleep(600) or x, "double")
        return whole(panel, trees, *args).withColumn("ic", hold("ic"))

    search_module.score_batch = slow
    try:
        jobs = Jobs(spark=spark, documents=Documents(tmp_path))
        jobs.submit("long", lambda stop, observe: run.run(stop=stop, observe=observe))
        assert started.wait(120)
        time.sleep(3)
        began = time.monotonic()
        assert jobs.cancel("long")
        best = jobs.result("long", 60)
    finally:
        search_module.score_batch = whole
    assert time.monotonic() - began < 30 and isinstance(best, Individual) and run.generation == 1 == run.history[-1]["generation"]
    state = Jobs(spark=spark, documents=Documents(tmp_path)).poll("long")  # after a restart
    assert state["state"] == "done" and state["progress"]["generation"] == 1
    p.unpersist()


def test_states_outlive_the_process(tmp_path):
    jobs, gate = Jobs(documents=Documents(tmp_path)), threading.Event()
    jobs.submit("going", lambda stop, observe: (observe({"n": 1}), gate.wait(60)))
    jobs.submit("bad", lambda stop, observe: 1 // 0)
    with pytest.raises(ZeroDivisionError):
        jobs.result("bad", 60)
    while jobs.poll("going")["progress"] is None:
        time.sleep(0.05)
    later = Jobs(documents=Documents(tmp_path))
    assert later.poll("going") | {"history": 0} == {"state": "interrupted", "stopping": False, "progress": {"n": 1}, "history": 0, "error": None}
    assert later.poll("bad")["state"] == "failed" and "ZeroDivision" in later.poll("bad")["error"]
    with pytest.raises(KeyError):
        later.poll("none")
    gate.set()
    jobs.result("going", 60)
    assert later.poll("going")["state"] == "done"


def test_seeds_beyond_the_population_raise(spark):
    s = Search(signal_panel(spark), config(population_size=2))
    with pytest.raises(ValueError, match="3 seeds"):
        s.initialize([parse(t) for t in ("close", "open", "low")])


def test_mutated_subtrees_may_use_the_depth_that_is_left():
    s = Search(None, config(max_depth=8, max_nodes=60, population_size=2))
    s.rng.seed(1)
    depths = {s._mutate_subtree(parse("close")).depth for _ in range(300)}
    assert max(depths) > 5 and max(depths) <= 8
    g = Generator(Registry(), random.Random(2), None, 60)
    assert all(g.tree("series", 8, 60, True).size <= 60 for _ in range(50))


def test_history_has_the_best_trees_ic(spark):
    s = Search(signal_panel(spark), config(generations=0))
    s.run([parse("rank(volume)")])
    row = s.history[0]
    assert row["best"] == max(q.fitness for q in s.population) and row["best_ic"] == max(s.population, key=lambda q: q.fitness).ic > 0
