
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.plans.compile import Compiler, evaluate, evaluate_batch
from factorloom.plans.expr import BUILTINS, OPERANDS, SERIES, WINDOW, ExprError, Node, Registry, from_json, parse, show, simplify, to_json
from factorloom.plans.search import Generator


def grid(seed=5, days=24, names=7):
    """A dense panel with gaps, ties, a flat run, a zero and one date without values."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for s in range(names):
            close = float(np.round(100 + rng.normal(), 1))
            gone = rng.random() < 0.12 or d == 9
            vol = 50.0 if s == 2 and 3 < d < 12 else float(rng.integers(0, 6))
            rows.append((pd.Timestamp("2024-01-01") + pd.Timedelta(days=d), f"S{s}", *([None] * 5 if gone else [close - 0.5, close + 1, close - 1, close, vol])))
    p = pd.DataFrame(rows, columns=["date", "symbol", "open", "high", "low", "close", "volume"])
    p["vwap"] = (p.high + p.low + p.close) / 3
    p["returns"] = p.groupby("symbol").close.transform(lambda x: x.pct_change(fill_method=None))
    return p


def panda(node, wide):
    """The tree's values by pandas: an evaluator of its own."""
    if not node.children:
        return wide[node.name]
    x = [panda(c, wide) for c in node.children if c.name not in ("const", "window")]
    v = next((c.value for c in node.children if c.name in ("const", "window")), None)
    a, b, n = x[0], x[1] if len(x) > 1 else None, node.name
    fin = lambda y: y.replace([np.inf, -np.inf], np.nan)
    roll = lambda y: fin(y).rolling(max(1, v), min_periods=max(1, v))
    with np.errstate(all="ignore"):
        return {
            "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: fin(a / b.replace(0, np.nan)), "mul_scalar": lambda: a * v, "add_scalar": lambda: a + v,
            "signed_power": lambda: fin(np.sign(a) * a.abs() ** v), "log": lambda: np.sign(a) * np.log1p(a.abs()), "abs": lambda: a.abs(), "sign": lambda: np.sign(a), "neg": lambda: -a,
            "ts_mean": lambda: roll(a).mean(), "ts_std": lambda: roll(a).std(), "ts_sum": lambda: roll(a).sum(), "ts_min": lambda: roll(a).min(), "ts_max": lambda: roll(a).max(),
            "ts_rank": lambda: roll(a).apply(lambda y: (y <= y[-1]).mean(), raw=True), "decay_linear": lambda: roll(a).apply(lambda y: (y * np.arange(1, len(y) + 1)).sum() / (len(y) * (len(y) + 1) / 2), raw=True),
            "delta": lambda: a - a.shift(v), "delay": lambda: a.shift(v),
            "ts_cov": lambda: roll(a).cov(fin(b)).where(roll(a).count().eq(v) & fin(b).rolling(v).count().eq(v)),
            "ts_corr": lambda: fin(roll(a).cov(fin(b)) / (roll(a).std() * fin(b).rolling(v).std()).replace(0, np.nan)),
            "rank": lambda: a.rank(axis=1, pct=True), "zscore": lambda: fin(a.sub(a.mean(axis=1), axis=0).div(a.std(axis=1).replace(0, np.nan), axis=0)),
            "scale": lambda: fin(a.div(a.abs().sum(axis=1).replace(0, np.nan), axis=0)),
            "gt": lambda: a > b, "lt": lambda: a < b, "ge": lambda: a >= b, "le": lambda: a <= b, "and_": lambda: a & b, "or_": lambda: a | b, "not_": lambda: ~a,
            "where": lambda: b.where(a, x[2]),
        }[n]()


@pytest.fixture(scope="module")
def panels(spark):
    p = grid()
    rows = [[str(r[0])[:10], r[1], *(None if x != x else float(x) for x in r[2:])] for r in p.itertuples(index=False)]
    df = spark.createDataFrame(rows, "date string, symbol string, open double, high double, low double, close double, volume double, vwap double, returns double")
    wide = {f: p.pivot(index="date", columns="symbol", values=f).astype(float) for f in OPERANDS}
    return df.selectExpr("to_date(date) as date", "symbol", *OPERANDS).cache(), wide


def check(panels, texts, registry=None):
    df, wide = panels
    trees = {f"t{i}": parse(t, registry) if isinstance(t, str) else t for i, t in enumerate(texts)}
    got = Compiler(registry).run(df, trees).toPandas()
    for k, t in trees.items():
        a = got.pivot(index="date", columns="symbol", values=k).to_numpy(float)
        b = panda((registry or Registry()).expand(t), wide).to_numpy(float)
        assert (np.isnan(a) == np.isnan(b)).all(), show(t)
        np.testing.assert_allclose(np.nan_to_num(a), np.nan_to_num(b), rtol=1e-7, atol=1e-8, err_msg=show(t))


def test_every_operator(panels):
    texts = []
    for name, op in BUILTINS.items():
        slots = {"series": ["close", "volume"], "scalar": ["0.5"], "window": ["4"], "bool": ["gt(close, open)", "lt(volume, returns)"]}
        took = {k: 0 for k in slots}
        args = []
        for a in op.args:
            args.append(slots[a][took[a] % len(slots[a])])
            took[a] += 1
        texts.append(f"{name}({', '.join(args)})")
    assert len(texts) == 33
    check(panels, [t for t in texts if not t.startswith(("gt", "lt", "ge", "le", "and_", "or_", "not_"))])
    check(panels, ["where(not_(gt(close, open)), close, open)", "where(or_(ge(close, high), le(volume, low)), returns, volume)"])


def test_nested_windows_and_shared_subtrees(panels):
    check(panels, ["rank(ts_mean(rank(close), 3))", "ts_mean(rank(close), 3)", "sub(rank(close), ts_corr(rank(volume), zscore(close), 4))", "delay(add(rank(close), close), 2)"])


def test_random_trees(panels):
    gen = Generator(Registry(), random.Random(3), set(["data", "arithmetic", "scalar", "unary_math", "time_series", "cross_sectional", "condition", "constant"]), 12)
    small = [Node(t.name, t.children, t.value) for t in gen.ramped(60, 2, 4) if all(n.name != "window" or n.value <= 5 for n in t)]
    trees = [t for t in small if not any(n.name in ("signed_power", "sign", "rank", "ts_rank", "gt", "lt", "ge", "le", "ts_corr", "zscore") for n in t)][:14]
    assert len(trees) > 5
    check(panels, trees)


def test_batch_equals_single(panels):
    df, _ = panels
    trees = [parse(t) for t in ("rank(ts_mean(volume, 3))", "zscore(close)", "close")]
    long = evaluate_batch(df, trees).toPandas()
    for i, t in enumerate(trees):
        one = evaluate(df, t).toPandas().merge(long[long.fid == i], on=["date", "symbol"])
        np.testing.assert_allclose(one.value_x.to_numpy(float), one.value_y.to_numpy(float), equal_nan=True)


@pytest.mark.parametrize("text", ["delay(close, -1)", "ts_mean(close, 0)", "add(close)", "foo(close)", "ts_mean(close, 2.5)", "close)", "add(close, gt(close, open))"])
def test_rejected(text):
    with pytest.raises(ExprError):
        Registry().validate(parse(text))


leaf = st.sampled_from([Node(n) for n in OPERANDS])
trees = st.recursive(leaf, lambda t: st.one_of(st.builds(lambda a, b: Node("add", (a, b)), t, t), st.builds(lambda a, w: Node("ts_mean", (a, Node("window", (), w))), t, st.integers(1, 60)), st.builds(lambda a, s: Node("mul_scalar", (a, Node("const", (), s))), t, st.floats(-5, 5)), st.builds(lambda a: Node("neg", (a,)), t)), max_leaves=8)


@given(trees)
@settings(max_examples=60, deadline=None)
def test_round_trips(t):
    assert from_json(to_json(t)) == t and parse(show(t)) == t
    assert simplify(simplify(t)) == simplify(t) and simplify(t).size <= t.size


def test_simplify():
    pairs = {"neg(neg(close))": "close", "abs(neg(close))": "abs(close)", "ts_mean(close, 1)": "close", "add_scalar(close, 0)": "close", "delay(close, 0)": "close", "sign(sign(close))": "sign(close)", "mul_scalar(abs(abs(close)), 1)": "abs(close)"}
    for a, b in pairs.items():
        assert show(simplify(parse(a))) == b


def test_macros(panels):
    reg = Registry()
    reg.register("rev", (SERIES, WINDOW), SERIES, parse("sub(ts_mean($0, $1), $0)"))
    reg.register("rev2", (SERIES,), SERIES, parse("neg(rev($x, 3))", reg, ("x",)))
    check(panels, ["rev2(close)", "rank(rev(volume, 2))"], reg)
    assert reg.required(parse("rev2(close)", reg)) == ["rev", "rev2"]
    with pytest.raises(ExprError):
        reg.register("rev", (SERIES,), SERIES, parse("neg($0)"))
    with pytest.raises(ExprError):
        reg.register("bad", (SERIES,), "bool", parse("neg($0)"))
