"""From trees to one DataFrame plan: shared subtrees once, windows in stages, batches in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import by_date, by_symbol, fin, nn, percent_rank, ratio, trailing
from .expr import BUILTINS, Node, Registry, simplify

_CROSS = ("rank", "zscore", "scale")
_TIME = tuple(n for n, o in BUILTINS.items() if o.category == "time_series")


def _finite_input(x: Column) -> Column:
    """Rolling operators take infinities for missing."""
    return F.when((x < float("inf")) & (x > float("-inf")), x)


def _full(x: Column, w: int, value: Column, also: Column | None = None) -> Column:
    """The value where all of the last ``w`` rows are there."""
    ok = F.count(x).over(trailing(w)) == w
    return F.when(ok if also is None else ok & (F.count(also).over(trailing(w)) == w), value)


#: Windows up to this many rows are summed row by row; longer ones are differences of running sums.
SHORT = 32


def _decayed(a: Column, w: int) -> Column:
    """The last ``w`` rows' sum, the newest times w and the oldest times 1: from sums of x and of x times its place
    in the line. A running sum's cost is the same for any window; where the window is short, summing it is cheap and
    loses no digits to what came long before."""
    place = F.row_number().over(by_symbol()).cast("double")
    x = F.coalesce(a, F.lit(0.0))
    before = place - w
    if w <= SHORT:
        return F.sum(a * place).over(trailing(w)) - before * F.sum(a).over(trailing(w))
    running = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_symbol().rowsBetween(Window.unboundedPreceding, -w)
    since = lambda c: F.sum(c).over(running) - F.coalesce(F.sum(c).over(ahead), F.lit(0.0))
    return since(x * place) - before * since(x)


def _time(name: str, x: list[Column], w: int) -> Column:
    if name == "delay":
        return F.lag(x[0], w).over(by_symbol()) if w else x[0]
    if name == "delta":
        return nn(x[0] - (F.lag(x[0], w).over(by_symbol()) if w else x[0]))
    w = max(1, w)
    over = trailing(w)
    a = _finite_input(x[0])
    if name in ("ts_cov", "ts_corr"):
        b = _finite_input(x[1])
        cov = F.covar_samp(a, b).over(over)
        value = cov if name == "ts_cov" else ratio(cov, F.stddev_samp(a).over(over) * F.stddev_samp(b).over(over))
        return _full(a, w, nn(value), b)
    if name == "ts_rank":
        seen = F.collect_list(a).over(over)
        return _full(a, w, F.size(F.filter(seen, lambda v: v <= a)) / F.lit(float(w)))
    if name == "decay_linear":
        return _full(a, w, _decayed(a, w) / F.lit(w * (w + 1) / 2))
    f = {"ts_mean": F.avg, "ts_std": F.stddev_samp, "ts_sum": F.sum, "ts_min": F.min, "ts_max": F.max}[name]
    return _full(a, w, nn(f(a).over(over)))


def cross(name: str, v: Column, *keys: str) -> Column:
    """A cross-sectional operator over the rows of ``keys``."""
    over = Window.partitionBy(*keys)
    if name == "rank":
        return percent_rank(v, *keys)
    if name == "zscore":
        return ratio(v - F.avg(v).over(over), F.stddev_samp(v).over(over))
    return ratio(v, F.sum(F.abs(v)).over(over))


def _element(name: str, x: list[Column], value: float | None) -> Column:
    a = x[0]
    b = x[1] if len(x) > 1 else None
    if name == "add":
        return nn(a + b)
    if name == "sub":
        return nn(a - b)
    if name == "mul":
        return nn(a * b)
    if name == "div":
        return ratio(a, b)
    if name == "mul_scalar":
        return nn(a * F.lit(float(value)))
    if name == "add_scalar":
        return nn(a + F.lit(float(value)))
    if name == "signed_power":
        return fin(F.signum(a) * F.pow(F.abs(a), F.lit(float(value))))
    if name == "log":
        return F.signum(a) * F.log1p(F.abs(a))
    if name in ("abs", "sign", "neg"):
        return F.abs(a) if name == "abs" else F.signum(a) if name == "sign" else -a
    if name in ("gt", "lt", "ge", "le"):
        test = {"gt": a > b, "lt": a < b, "ge": a >= b, "le": a <= b}[name]
        return F.coalesce(test, F.lit(False))
    if name in ("and_", "or_", "not_"):
        return ~a if name == "not_" else a & b if name == "and_" else a | b
    return F.when(a, b).otherwise(x[2])


class Compiler:
    """Columns for any number of trees over one panel.

    Equal subtrees share a column. Elementwise operators stay expressions in whole-stage codegen. A window
    operator's inputs are columns of the stage before (windows don't nest), and each stage adds first all
    its time-series columns, then all its cross-sectional ones, so rows are dealt by symbol and by date
    once a stage at most, whatever the number of trees.
    """

    def __init__(self, registry: Registry | None = None) -> None:
        self.registry = registry or Registry()
        self.stages: list[dict[str, dict[str, Column]]] = []
        self.done: dict[Node, tuple[int, Column]] = {}
        self.serial = 0

    def _kind(self, name: str) -> str:
        return "cross" if name in _CROSS else "time"

    def column(self, node: Node) -> tuple[int, Column]:
        """The stage after which a node's column can be read, and the column. Stage 2 s + 1 is the time-series
        half of step s, 2 s + 2 the cross-sectional half."""
        if node in self.done:
            return self.done[node]
        parts = [self.column(c) for c in node.children if c.name not in ("const", "window")]
        value = next((c.value for c in node.children if c.name in ("const", "window")), None)
        ready = max((s for s, _ in parts), default=0)
        x = [c for _, c in parts]
        if not node.children:
            found = (0, F.col(node.name))
        elif node.name in _TIME or node.name in _CROSS:
            odd = node.name in _TIME
            stage = ready + 1 if (ready + 1) % 2 == odd else ready + 2
            inputs = []
            for (s, c), child in zip(parts, (c for c in node.children if c.name not in ("const", "window")), strict=True):
                inputs.append(self._named(child, s, c, stage))
            name = self._name()
            self._put(stage, "window", name, _time(node.name, inputs, int(value)) if odd else cross(node.name, inputs[0], "date"))
            found = (stage, F.col(name))
        else:
            found = (ready, _element(node.name, x, value))
        self.done[node] = found
        return found

    def _name(self) -> str:
        self.serial += 1
        return f"__n{self.serial}"

    def _put(self, stage: int, kind: str, name: str, column: Column) -> None:
        while len(self.stages) < stage:
            self.stages.append({"input": {}, "window": {}})
        self.stages[stage - 1][kind][name] = column

    def _named(self, node: Node, ready: int, column: Column, stage: int) -> Column:
        """An input of a window as a plain column, made just before the stage."""
        if not node.children or node.name in _TIME or node.name in _CROSS:
            return column
        made = self.done.get((node, "named"))
        if made and made[0] <= stage:
            return made[1]
        name = self._name()
        self._put(stage, "input", name, column)
        self.done[node, "named"] = (stage, F.col(name))  # an earlier stage, if asked for, gets its own
        return F.col(name)

    def run(self, panel: DataFrame, outputs: dict[str, Node]) -> DataFrame:
        """``panel`` with a column for each output."""
        trees = {k: simplify(self.registry.expand(self.registry.validate(n, self.registry.infer(n)))) for k, n in outputs.items()}
        columns = {k: self.column(n)[1] for k, n in trees.items()}
        df = panel
        for s in self.stages:
            if s["input"]:
                df = df.select("*", *(c.alias(k) for k, c in s["input"].items()))
            if s["window"]:
                df = df.select("*", *(c.alias(k) for k, c in s["window"].items()))
        return df.select(*panel.columns, *(c.alias(k) for k, c in columns.items()))


def evaluate(panel: DataFrame, node: Node, registry: Registry | None = None, name: str = "value") -> DataFrame:
    """A tree's values: date, symbol, value."""
    return Compiler(registry).run(panel, {name: node}).select("date", "symbol", name)


#: Shuffle partitions beside the session's own for each tree of a batch.
SPREAD = 32


def evaluate_batch(panel: DataFrame, trees: Sequence[Node], registry: Registry | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """All trees' values in long form: fid, date, symbol, value and columns of the panel to ``keep``.

    Outermost cross-sectional operators are taken in the long form, by (fid, date): two sorts for all trees
    and not two for each. The number of parts is given: rows of few columns are small when written, so that parts
    put together by written size would have many cross-sections to sort in one task.
    """
    registry = registry or Registry()
    outer, inner = [], {}
    for i, t in enumerate(trees):
        t = simplify(registry.expand(registry.validate(t)))
        outer.append(t.name if t.name in _CROSS else "")
        inner[f"__f{i}"] = t.children[0] if outer[i] else t
    wide = Compiler(registry).run(panel, inner).select("date", "symbol", *keep, *inner)
    if not inner:
        raise ValueError("no trees")
    entries = F.explode(F.array(*(F.struct(F.lit(i).alias("fid"), F.lit(outer[i]).alias("outer"), F.col(f"__f{i}").alias("v")) for i in range(len(outer)))))
    long = wide.select("date", "symbol", *keep, entries.alias("e")).select("e.fid", "date", "symbol", *keep, "e.outer", "e.v")
    long = long.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")) + SPREAD * len(outer), "fid", "date")
    v = F.col("v")
    value = v
    for kind in sorted(set(outer) - {""}):
        value = F.when(F.col("outer") == kind, cross(kind, v, "fid", "date")).otherwise(value)
    return long.select("fid", "date", "symbol", *keep, value.alias("value"))


__all__ = ["Compiler", "by_date", "cross", "evaluate", "evaluate_batch"]
