"""Evolutionary search over trees: breeding on the driver, one Spark job a generation for scores."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage as lineage_table
from ..operators.score import score_batch
from ..sources import files
from .expr import BOOL, OPERANDS, SCALAR, SCALARS, SERIES, SIGNAL, WINDOW, WINDOWS, ExprError, Node, Registry, from_dict, is_subtype, positions, replace_at, simplify, to_dict, to_json


@dataclass
class Config:
    population_size: int = 200
    generations: int = 25
    tournament_size: int = 3
    crossover_rate: float = 0.8
    subtree_mutation_rate: float = 0.1
    point_mutation_rate: float = 0.1
    max_depth: int = 6
    max_nodes: int = 40
    min_depth: int = 2
    parsimony: float = 1e-3
    elitism: int = 1
    ic_method: str = "spearman"
    min_names: int = 5
    horizon: int = 1
    seed: int = 0
    time_budget_s: float | None = None
    enabled_categories: list[str] | None = None
    #: Trees to a Spark job.
    chunk: int = 32

    @classmethod
    def from_dict(cls, data: dict) -> Config:
        names = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in data.items() if k in names})


class Generator:
    """Random well-typed trees within a depth and a number of nodes."""

    def __init__(self, registry: Registry, rng: random.Random, enabled: set[str] | None = None, max_nodes: int = 40) -> None:
        self.registry, self.rng, self.max_nodes = registry, rng, max_nodes
        self.ops = [registry.op(n) for n in registry.names(enabled)]
        self.least = self._least()

    def _least(self) -> dict[str, tuple[int, int]]:
        """Fewest nodes and least depth for each type, to a fixed point."""
        cost = {SERIES: (1, 1), SIGNAL: (1, 1), SCALAR: (1, 1), WINDOW: (1, 1)}
        while True:
            new = dict(cost)
            for op in self.ops:
                if all(a in new for a in op.args):
                    got = (1 + sum(new[a][0] for a in op.args), 1 + max(new[a][1] for a in op.args))
                    if op.out not in new or got < new[op.out]:
                        new[op.out] = got
            if new == cost:
                return cost
            cost = new

    def terminal(self, kind: str) -> Node | None:
        if kind == WINDOW:
            return Node("window", (), self.rng.choice(WINDOWS))
        if kind == SCALAR:
            return Node("const", (), self.rng.choice(SCALARS))
        return Node(self.rng.choice(OPERANDS)) if is_subtype(SERIES, kind) else None

    def tree(self, kind: str, depth: int, nodes: int, full: bool) -> Node:
        """A tree of this type. ``full`` takes operators as long as any fits; else operands mix in."""
        fits = [o for o in self.ops if is_subtype(o.out, kind) and all(a in self.least for a in o.args) and 1 + max(self.least[a][1] for a in o.args) <= depth and 1 + sum(self.least[a][0] for a in o.args) <= nodes]
        leaf = kind != BOOL
        if not fits or kind in (WINDOW, SCALAR) or (leaf and not full and self.rng.random() < 0.3):
            found = self.terminal(kind) if leaf else None
            if found is None and not fits:
                raise ExprError(f"no tree of type {kind} fits")
            if found is not None:
                return found
        op = self.rng.choice(fits)
        left, children = nodes - 1, []
        for i, a in enumerate(op.args):
            others = sum(self.least[b][0] for b in op.args[i + 1 :])
            child = self.tree(a, depth - 1, left - others, full)
            left -= child.size
            children.append(child)
        return Node(op.name, tuple(children))

    def ramped(self, n: int, low: int, high: int) -> list[Node]:
        """Depths in turn from low to high; even ones grown, odd ones full."""
        return [self.tree(SERIES, low + (i // 2) % max(1, high - low + 1), self.max_nodes, bool(i % 2)) for i in range(n)]


@dataclass
class Individual:
    tree: Node
    fitness: float
    ic: float = 0.0
    id: int = -1


def tree_key(tree: Node) -> str:
    """A tree's identity: the hash of its canonical form."""
    return sha256(to_json(tree).encode()).hexdigest()


def panel_key(panel: DataFrame) -> str:
    """A hash of a panel's rows, in any order."""
    h = F.xxhash64(*(F.col(c) for c in sorted(panel.columns)))
    r = panel.agg(F.count("*"), F.sum(h.cast("decimal(38,0)"))).first()
    return f"{r[0]}:{r[1]}"


@dataclass
class ScoreMemo:
    """Scores of trees as a table: scope (panel and scoring), run, tree (a hash), fitness, ic.

    Runs and sessions share it. Rows are only added, a file an addition, and equal ones count once, so an
    addition that is made again changes nothing.
    """

    spark: SparkSession
    path: str
    SCHEMA = "run string, tree string, fitness double, ic double, scope string"

    def _rows(self, scope: str) -> DataFrame:
        there = files.exists(self.spark, self.path)
        return (self.spark.read.schema(self.SCHEMA).parquet(self.path) if there else self.spark.createDataFrame([], self.SCHEMA)).where(F.col("scope") == scope)

    def find(self, scope: str, trees: Sequence[str]) -> dict[str, tuple[float, float]]:
        """Those of ``trees`` that any run has scored."""
        asked = self.spark.createDataFrame([(t,) for t in trees], "tree string")
        rows = self._rows(scope).join(asked, "tree", "left_semi").select("tree", "fitness", "ic").distinct().collect()
        return {r["tree"]: (r["fitness"], r["ic"]) for r in rows}

    def of_run(self, scope: str, run: str) -> dict[str, tuple[float, float]]:
        rows = self._rows(scope).where(F.col("run") == run).select("tree", "fitness", "ic").distinct().collect()
        return {r["tree"]: (r["fitness"], r["ic"]) for r in rows}

    def add(self, scope: str, run: str, scores: dict[str, tuple[float, float]]) -> None:
        if scores:
            rows = [(run, t, f, ic, scope) for t, (f, ic) in scores.items()]
            self.spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").partitionBy("scope").parquet(self.path)


@dataclass
class Search:
    """A seeded run over one panel. State can be saved after each generation and taken up again."""

    panel: DataFrame
    config: Config
    registry: Registry = field(default_factory=Registry)
    run_id: str = "run"
    #: Scores that other runs over the same panel share, and that outlive this one.
    memo: ScoreMemo | None = None

    def __post_init__(self) -> None:
        self.rng = random.Random(self.config.seed)
        #: Trees tried by this run, by tree_key().
        self.known: dict[str, tuple[float, float]] = {}
        self._scope: str | None = None
        self.prior_trials, self.generation = 0, 0
        self.population: list[Individual] = []
        self.history: list[dict] = []
        self.records: list[tuple] = []
        self._generator()

    def _generator(self) -> None:
        enabled = set(self.config.enabled_categories) if self.config.enabled_categories is not None else None
        self.generate = Generator(self.registry, self.rng, enabled, self.config.max_nodes)

    @property
    def trials(self) -> int:
        return self.prior_trials + len(self.known)

    def scope(self) -> str:
        """What a score depends on besides the tree: the panel's rows and how they are scored."""
        if self._scope is None:
            c = self.config
            macros = {k: to_dict(m.body) for k, m in sorted(self.registry.macros.items())}
            self._scope = sha256(json.dumps([panel_key(self.panel), c.parsimony, c.ic_method, c.min_names, c.horizon, macros]).encode()).hexdigest()
        return self._scope

    def score(self, trees: Sequence[Node]) -> list[tuple[float, float]]:
        """(fitness, ic) of each; a tree scored before, by this run or by one that shares its memo, isn't scored
        again. Fitness is rounded, so that noise of floating point doesn't turn tournaments."""
        keys = [tree_key(t) for t in trees]
        new = {k: t for k, t in zip(keys, trees, strict=True) if k not in self.known}
        if self.memo and new:
            found = self.memo.find(self.scope(), list(new))
            self.memo.add(self.scope(), self.run_id, found)
            self.known |= found
            new = {k: t for k, t in new.items() if k not in found}
        c, left = self.config, list(new.items())
        for at in range(0, len(left), c.chunk):
            part = left[at : at + c.chunk]
            rows = score_batch(self.panel, [t for _, t in part], c.parsimony, c.ic_method, c.min_names, c.horizon, self.registry).collect()
            scored = {part[r["fid"]][0]: (round(r["fitness"], 12), round(r["ic"], 12)) for r in rows}
            if self.memo:
                self.memo.add(self.scope(), self.run_id, scored)
            self.known |= scored
        return [self.known[k] for k in keys]

    def validate_seed(self, tree: Node) -> Node:
        self.registry.validate(tree)
        if tree.depth > self.config.max_depth or tree.size > self.config.max_nodes:
            raise ExprError("a seed tree is too large")
        return tree

    def _tournament(self) -> int:
        picks = [self.rng.randrange(len(self.population)) for _ in range(self.config.tournament_size)]
        return max(picks, key=lambda i: (self.population[i].fitness, -i))

    def _fits(self, t: Node) -> bool:
        return t.depth <= self.config.max_depth and t.size <= self.config.max_nodes

    def _crossover(self, a: Node, b: Node) -> Node:
        for _ in range(8):
            path, slot, _ = self.rng.choice(list(positions(a, self.registry)))
            donors = [n for _, _, n in positions(b, self.registry) if is_subtype(self.registry.infer(n), slot)]
            if donors and self._fits(child := replace_at(a, path, self.rng.choice(donors))):
                return child
        return a

    def _mutate_subtree(self, a: Node) -> Node:
        path, slot, old = self.rng.choice(list(positions(a, self.registry)))
        depth, nodes = self.config.max_depth - len(path), self.config.max_nodes - (a.size - old.size)
        try:
            child = replace_at(a, path, self.generate.tree(slot, depth, nodes, False))
        except ExprError:
            return a
        return child if self._fits(child) else a

    def _mutate_point(self, a: Node) -> Node:
        path, slot, old = self.rng.choice(list(positions(a, self.registry)))
        if old.name in OPERANDS:
            return replace_at(a, path, Node(self.rng.choice([x for x in OPERANDS if x != old.name])))
        if not old.children:
            return replace_at(a, path, self.generate.terminal(slot) or old)
        own = self.registry.op(old.name)
        same = [o.name for o in self.generate.ops if o.args == own.args and o.out == own.out and o.name != old.name]
        return replace_at(a, path, Node(self.rng.choice(same) if same else old.name, old.children))

    def _offspring(self) -> tuple[Node, list[int], str]:
        c, i = self.config, self._tournament()
        tree, parents, ops = self.population[i].tree, [i], ["reproduction"]
        if self.rng.random() < c.crossover_rate:
            j = self._tournament()
            tree, ops = self._crossover(tree, self.population[j].tree), ["crossover"]
            parents.append(j)
        if self.rng.random() < c.subtree_mutation_rate:
            tree, ops = self._mutate_subtree(tree), [*ops, "subtree_mut"]
        if self.rng.random() < c.point_mutation_rate:
            tree, ops = self._mutate_point(tree), [*ops, "point_mut"]
        return tree, parents, "+".join(ops)

    def _adopt(self, entries: list[tuple[Node, list[int], str]], generation: int) -> None:
        ids = [p.id for p in self.population]
        scores = self.score([t for t, _, _ in entries])  # nothing changes before all are scored
        self.generation = generation
        self.population = [Individual(t, f, ic, len(self.records) + k) for k, ((t, _, _), (f, ic)) in enumerate(zip(entries, scores, strict=True))]
        self.records += [(self.run_id, p.id, self.generation, op, [ids[i] for i in parents], to_json(p.tree), p.fitness) for p, (_, parents, op) in zip(self.population, entries, strict=True)]
        fit = [p.fitness for p in self.population]
        self.history.append({"generation": self.generation, "best": max(fit), "mean": sum(fit) / len(fit), "best_ic": self.population[fit.index(max(fit))].ic, "trials": self.trials})

    def initialize(self, seeds: Sequence[Node] = ()) -> None:
        """The first generation: seeds, then random trees. Raises if there are more seeds than places."""
        c = self.config
        trees = [*map(self.validate_seed, seeds)]
        if len(trees) > c.population_size:
            raise ValueError(f"{len(trees)} seeds for a population of {c.population_size}")
        new = self.generate.ramped(c.population_size - len(trees), c.min_depth, c.max_depth)
        self._adopt([*((t, [], "seed") for t in trees), *((t, [], "init") for t in new)], 0)

    def step(self) -> None:
        """All children are bred first (breeding needs only the parents' fitness), then scored together."""
        c = self.config
        order = sorted(range(len(self.population)), key=lambda i: (-self.population[i].fitness, i))
        entries = [(self.population[i].tree, [i], "elite") for i in order[: c.elitism]]
        while len(entries) < c.population_size:
            entries.append(self._offspring())
        self._adopt(entries, self.generation + 1)

    def run(self, seeds: Sequence[Node] = (), stop: Callable[[], bool] | None = None, observe: Callable[[dict], None] | None = None) -> Individual:
        """To the last generation, or until ``stop`` or the time budget; ``observe`` gets each one's figures."""
        began = time.monotonic()
        seen = observe or (lambda _: None)
        if not self.population:
            self.initialize(seeds)
            seen(self.progress())
        while self.generation < self.config.generations and not (stop and stop()):
            if self.config.time_budget_s is not None and time.monotonic() - began > self.config.time_budget_s:
                break
            before = self.rng.getstate()
            try:
                self.step()
            except Exception:
                if not (stop and stop()):
                    raise
                self.rng.setstate(before)  # its jobs were interrupted: the run ends with the generation before
                break
            seen(self.progress())
        return self.best()

    def progress(self) -> dict:
        """Generation, generations to go to, and the best tree so far."""
        best = self.best()
        return {"generation": self.generation, "target": self.config.generations, **self.history[-1], "best_tree": to_json(best.tree)}

    def best(self) -> Individual:
        """The first of largest fitness, simplified."""
        b = max(self.population, key=lambda p: p.fitness)
        return Individual(simplify(b.tree), b.fitness, b.ic, b.id)

    def rescore(self) -> None:
        """Scores the population anew (after a change of panel or scoring); trials so far still count."""
        self.prior_trials += len(self.known)
        self.known, self._scope = {}, None
        for p, (f, ic) in zip(self.population, self.score([p.tree for p in self.population]), strict=True):
            p.fitness, p.ic = f, ic

    def lineage(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.records, lineage_table.SCHEMA)

    def save(self) -> str:
        state = self.rng.getstate()
        return json.dumps({
            "config": asdict(self.config), "rng": [state[0], list(state[1]), state[2]], "generation": self.generation, "history": self.history, "trials": self.trials, "run_id": self.run_id,
            "population": [{"tree": to_dict(p.tree), "fitness": p.fitness, "ic": p.ic, "id": p.id} for p in self.population], "records": self.records,
        })

    @classmethod
    def load(cls, panel: DataFrame, text: str, registry: Registry | None = None, config: Config | None = None, memo: ScoreMemo | None = None) -> Search:
        """Takes a run up; with a new ``config`` the generator's limits follow it. With a memo, trees that the run
        has tried under the same scoring are known: they are neither scored nor counted again."""
        d = json.loads(text)
        s = cls(panel, config or Config.from_dict(d["config"]), registry or Registry(), d["run_id"], memo)
        s.rng.setstate((d["rng"][0], tuple(d["rng"][1]), d["rng"][2]))
        s.generation, s.history, s.prior_trials = d["generation"], d["history"], d["trials"]
        s.population = [Individual(from_dict(p["tree"]), p["fitness"], p["ic"], p["id"]) for p in d["population"]]
        s.records = [tuple(r) for r in d["records"]]
        s._generator()
        if memo:
            s.known = memo.of_run(s.scope(), s.run_id)
            s.prior_trials = max(0, s.prior_trials - len(s.known))
        return s
