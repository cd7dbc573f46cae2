"""Runs with a verdict: one search, and sessions of search segments over frozen dates."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from threading import Event
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import overfit, portfolio, splits
from ..operators.score import forward_returns
from ..sources.library import Documents, slug
from .compile import Compiler
from .expr import BUILTINS, Node, Registry, from_dict, show, to_dict
from .search import Config, ScoreMemo, Search


@dataclass
class TrialCounter:
    """Trials so far, over all searches that saw the same test dates."""

    total: int = 0

    def add(self, n: int) -> int:
        self.total += n
        return self.total


def net_returns(panel: DataFrame, tree: Node, scheme: str = "quantile", costs: portfolio.Costs | None = None, horizon: int = 1, registry: Registry | None = None) -> DataFrame:
    """A tree's net returns as a portfolio: date, ret."""
    values = Compiler(registry).run(forward_returns(panel, horizon), {"value": tree})
    return portfolio.backtest_daily(values, scheme, costs).select("date", F.col("net").alias("ret"))


def build_report(panel: DataFrame, search: Search, segments: DataFrame, trials: int, schemes: int = 1, horizon: int | None = None) -> dict:
    """The judge's verdict on a search's best tree; trials grow with the palette beyond the built-in one."""
    best, registry = search.best(), search.registry
    palette, base = len(search.generate.ops), len(Registry().names())
    counted = overfit.effective_trials(trials, schemes, palette, base) if palette > base else overfit.effective_trials(trials, schemes)
    population = [p.tree for p in search.population]
    verdict = overfit.judge(panel, best.tree, population, segments.where("segment <> 'test'"), segments.where("segment = 'test'"), counted, horizon or search.config.horizon, search.config.min_names, registry=registry)
    return {"best": show(best.tree), "tree": to_dict(best.tree), "fitness": best.fitness, "history": search.history, "raw_trials": trials, **verdict}


@contextmanager
def _held(df: DataFrame) -> Iterator[DataFrame]:
    """A frame that stays in memory until the block ends, however it ends."""
    df = df.cache()
    try:
        yield df
    finally:
        df.unpersist()


def run_search(panel: DataFrame, config: Config, registry: Registry | None = None, seeds: Sequence[Node] = (), stop: Callable[[], bool] | None = None, train: float = 0.6, valid: float = 0.2, embargo: int = 5, observe: Callable[[dict], None] | None = None, memo: ScoreMemo | None = None) -> tuple[dict, Search]:
    """Splits the dates, searches on training dates only (their labels stay inside), and judges on all."""
    with _held(splits.time_split(splits.date_line(panel), train, valid, embargo)) as segments, _held(panel.join(segments.where("segment = 'train'").select("date"), "date", "left_semi")) as own:
        search = Search(own, config, registry or Registry(), memo=memo)
        search.run(seeds, stop, observe)
        return build_report(panel, search, segments, search.trials), search


@dataclass
class Session:
    """Segments of search over dates frozen at the start; each report reads the test dates once more."""

    name: str
    documents: Documents
    frozen: dict[str, tuple[date, date]] = field(default_factory=dict)
    counter: TrialCounter = field(default_factory=TrialCounter)
    test_reads: int = 0
    reports: list[dict] = field(default_factory=list)
    checkpoint: str | None = None
    operators: list[str] = field(default_factory=list)
    running: bool = False

    @classmethod
    def start(cls, name: str, documents: Documents, panel: DataFrame, train: float = 0.6, valid: float = 0.2, embargo: int = 5) -> Session:
        return cls(name, documents, splits.boundaries(splits.time_split(splits.date_line(panel), train, valid, embargo)))

    def segment(self, panel: DataFrame, config: Config, registry: Registry | None = None, seeds: Sequence[Node] = (), stop: Callable[[], bool] | None = None, observe: Callable[[dict], None] | None = None, memo: ScoreMemo | None = None) -> dict:
        """A first or further segment. A further one goes on from the checkpoint; scores are taken anew if
        scoring changed. Trials add up over segments."""
        if self.running:
            raise RuntimeError("the session is running")
        self.running = True
        try:
            with _held(splits.apply_boundaries(splits.date_line(panel), self.frozen)) as segments, _held(panel.join(segments.where("segment = 'train'").select("date"), "date", "left_semi")) as own:
                if segments.where("segment = 'train'").agg(F.max("date")).first()[0] >= self.frozen["test"][0]:
                    raise ValueError("training dates reach into the test dates")
                if self.checkpoint is None:
                    search = Search(own, config, registry or Registry(), self.name, memo)
                    search.initialize(seeds)
                else:
                    before = Config.from_dict(json.loads(self.checkpoint)["config"])
                    search = Search.load(own, self.checkpoint, registry, config, memo)
                    tried = len(search.known)  # of the memo: counted by the segments before
                    search.prior_trials = -tried
                    if any(getattr(before, k) != getattr(config, k) for k in ("parsimony", "ic_method", "min_names", "horizon")):
                        search.rescore()
                    search.config = replace(config, generations=config.generations + search.generation)
                search.run(stop=stop, observe=observe)
                self.counter.add(search.trials)
                self.test_reads += 1
                report = build_report(panel, search, segments, self.counter.total)
                report |= {"test_reads": self.test_reads, "warning": "the test dates have been read before" if self.test_reads > 1 else None}
                search.prior_trials += self.counter.total - search.trials
                self.checkpoint = search.save()
                self.operators = sorted(set(search.registry.macros) & {n.name for p in search.population for n in p.tree})
                self.reports.append(report)
                self.save()
                return report
        finally:
            self.running = False

    def save(self) -> None:
        self.documents.put(self.name, {"frozen": {k: [str(a), str(b)] for k, (a, b) in self.frozen.items()}, "trials": self.counter.total, "test_reads": self.test_reads, "reports": self.reports, "checkpoint": self.checkpoint, "operators": self.operators})

    @classmethod
    def load(cls, name: str, documents: Documents) -> Session:
        d = documents.get(name)
        frozen = {k: (date.fromisoformat(a), date.fromisoformat(b)) for k, (a, b) in d["frozen"].items()}
        return cls(name, documents, frozen, TrialCounter(d["trials"]), d["test_reads"], d["reports"], d["checkpoint"], d.get("operators", []))


def export_run(report: dict, search: Search) -> str:
    """A run as one JSON document: verdict, configuration, history and lineage."""
    for key in ("best", "tree", "dsr", "pbo", "oos_ic"):
        if key not in report:
            raise ValueError(f"the report lacks {key}")
    keys = ("run_id", "id", "generation", "op", "parents", "tree", "fitness")
    return json.dumps({"report": report, "config": asdict(search.config), "history": search.history, "lineage": [dict(zip(keys, r, strict=True)) for r in search.records]})


def validate_export(text: str) -> dict:
    """The document, if its report is whole and all its trees can be read; else raises."""
    data = json.loads(text)
    for key in ("best", "tree", "dsr", "pbo", "oos_ic"):
        if key not in data.get("report", {}):
            raise ValueError(f"the report lacks {key}")
    from_dict(data["report"]["tree"])
    for r in data["lineage"]:
        if missing := {"id", "generation", "op", "parents", "tree"} - set(r):
            raise ValueError(f"a lineage record lacks {sorted(missing)}")
        from_dict(json.loads(r["tree"]))
    return data


@dataclass
class Jobs:
    """Long calls in the background, by name: state, figures so far, result or error.

    A call's Spark jobs carry its tag, so that a stop ends what runs on the cluster at once. With ``documents``
    states outlive the process: what another process left running is told as ``interrupted``.
    """

    workers: int = 2
    spark: SparkSession | None = None
    documents: Documents | None = None

    def __post_init__(self) -> None:
        self._pool = ThreadPoolExecutor(self.workers)
        self._jobs: dict[str, tuple[Future, Event, list]] = {}
        self._owner = uuid.uuid4().hex

    def _tag(self, name: str) -> str:
        return f"factorloom-{self._owner}-{slug(name)}"

    def _note(self, name: str, state: str, seen: list, error: str | None = None) -> None:
        if self.documents:
            self.documents.put(name, {"state": state, "owner": self._owner, "progress": seen[-1] if seen else None, "error": error})

    def submit(self, name: str, call: Callable, *args, **options) -> str:
        """Runs ``call(*args, stop=, observe=, **options)``, which asks stop() and tells observe(figures)."""
        if name in self._jobs and not self._jobs[name][0].done():
            raise RuntimeError(f"{name} is running")
        stop, seen = Event(), []

        def observe(figures: dict) -> None:
            seen.append(figures)
            self._note(name, "running", seen)

        def run() -> object:
            if self.spark:
                self.spark.sparkContext.addJobTag(self._tag(name))  # this thread's jobs
            try:
                self._note(name, "running", seen)
                out = call(*args, stop=stop.is_set, observe=observe, **options)
                self._note(name, "done", seen)
                return out
            except BaseException as e:
                self._note(name, "cancelled" if stop.is_set() else "failed", seen, repr(e))
                raise
            finally:
                if self.spark:
                    self.spark.sparkContext.removeJobTag(self._tag(name))

        self._note(name, "queued", seen)
        self._jobs[name] = (self._pool.submit(run), stop, seen)
        return name

    def poll(self, name: str) -> dict:
        if name not in self._jobs:
            if not self.documents or slug(name) not in self.documents.keys():
                raise KeyError(name)
            d = self.documents.get(name)
            state = "interrupted" if d["state"] in ("queued", "running") else d["state"]
            return {"state": state, "stopping": False, "progress": d["progress"], "history": [], "error": d["error"]}
        future, stop, seen = self._jobs[name]
        error = future.exception() if future.done() else None
        state = ("cancelled" if stop.is_set() else "failed") if error else "done" if future.done() else "running" if future.running() or seen else "queued"
        return {"state": state, "stopping": stop.is_set(), "progress": seen[-1] if seen else None, "history": list(seen), "error": repr(error) if error else None}

    def result(self, name: str, timeout: float | None = None):
        return self._jobs[name][0].result(timeout)

    def cancel(self, name: str) -> bool:
        """Stops a job: its Spark jobs end, and a search gives the last whole generation."""
        if name not in self._jobs:
            return False
        self._jobs[name][1].set()
        if self.spark:
            self.spark.sparkContext.cancelJobsWithTag(self._tag(name))
        return True


def catalogue(registry: Registry | None = None) -> list[dict]:
    """All operators for display: name, label, category, arguments, result, help."""
    registry = registry or Registry()
    return [{"name": n, "label": n.strip("_").replace("ts_", "rolling ").replace("_", " "), "category": registry.category(n), "args": list(o.args), "out": o.out, "doc": o.doc, "macro": n not in BUILTINS} for n, o in {**BUILTINS, **registry.macros}.items()]


__all__ = ["Jobs", "Session", "TrialCounter", "build_report", "catalogue", "export_run", "from_dict", "net_returns", "run_search", "validate_export"]
