"""MinHash near-duplicates by an LSH forest against all pairs."""

import random
import re

import numpy as np
import pytest

from factorloom.llm import forest, queries

SCHEMA = "doc_id bigint, text string, fp bigint, n bigint, ring binary, id string, root bigint, copies bigint, component_id bigint"


def shingle_set(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute(rows, part=85, whole=100):
    sets = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and whole * len(a & b) >= part * len(a | b):
                up[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        least = min(ids) if ids else None
        out += [(rows[i][0], len(sets[i]), least, rows[i][0] == least) for i in members]
    return sorted(map(str, out))


def changed(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(["new", "other", "x"])
    return " ".join(w)


def corpus(seed=1, families=12, most=8):
    rng = random.Random(seed)
    word = lambda: rng.choice("the of and some text with words that make it long enough to be cut in parts".split()) + rng.choice(["", "", "s", "ed"])
    base = [" ".join(word() for _ in range(rng.choice([30, 80, 200]))) for _ in range(families)]
    near = [changed(rng, b, rng.randrange(5)) for b in base for _ in range(rng.randrange(most))]
    chain = [base[0]]
    for _ in range(20):
        chain.append(changed(rng, chain[-1], 1))
    return [None, "", " \n", "one", "One", "four words in all", "Four words in ALL", "five words are in here", *base, *near, *chain, base[1].upper(), base[2] + "\n" + base[3], "日本語 " * 9, "w " * 30_000, " ".join(word() for _ in range(20_000))]


def table(spark, rows):
    return spark.createDataFrame([(*r, 5, 6, b"7", "x", 1, 2, 3) for r in rows], SCHEMA).repartition(3)


def found(df):
    return sorted(str(tuple(r)) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_stars(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5)]
    rng.shuffle(links)
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    want = {(x, root(x)) for pair in links for x in pair if root(x) != x}
    for parts in (1, 7):
        got = forest.stars(spark.createDataFrame(links, "a bigint, b bigint").repartition(parts), "stars")
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert forest.stars(spark.createDataFrame([], "a bigint, b bigint"), "stars").collect() == []


@pytest.mark.parametrize("options", [{}, {"depths": (2, 4, 6), "large": 4}, {"depths": (1,), "large": 3}, {"large_shingles": 100}])
def test_near_duplicates(spark, options):
    queries.ship(spark)
    ts = corpus()
    rows = [((i * 7) % 1000, t) for i, t in enumerate(ts)]
    rows += [rows[9], rows[9], (None, ts[10]), (None, None), (None, "of a null id and no other like it at all"), (-4, "")]
    assert found(forest.near_duplicates(table(spark, rows), **options)) == brute(rows)


def test_filter_loses_no_row(spark, monkeypatch):
    rows, asked = spark.range(5000).withColumnRenamed("id", "row"), spark.range(0, 5000, 50).withColumnRenamed("id", "row")
    for bits, most in ((1 << 24, 110), (1 << 10, 1000)):
        monkeypatch.setattr(forest, "FILTER_BITS", bits)
        got = {r["row"] for r in forest.filtered(rows, asked, "row").collect()}
        assert got >= set(range(0, 5000, 50)) and len(got) <= most


def test_none(spark):
    assert forest.near_duplicates(table(spark, [])).collect() == []
    assert found(forest.near_duplicates(table(spark, [(1, None), (None, " ")]))) == sorted([str((1, 0, 1, True)), str((None, 0, None, True))])


def test_other_similarity(spark):
    rows = list(enumerate(corpus(3)))
    assert found(forest.near_duplicates(table(spark, rows), similarity=(4, 5))) == brute(rows, 80)


def test_enough_orders():
    """Of pairs at the similarity, the share that meets in a region of a few orders is as computed."""
    for depth in (6, 12, 24):
        n = forest.trees(depth)
        assert (1 - 0.85**depth) ** n <= 1e-7 < (1 - 0.85**depth) ** (n - 1)
    rng, met = np.random.default_rng(5), 0
    for _ in range(400):
        common, a, b = (rng.integers(1 << 63, size=k, dtype=np.uint64) for k in (170, 15, 15))
        x, y = (np.frombuffer(forest.ring(np.concatenate([common, own]), 12), np.uint8).reshape(2, 6) for own in (a, b))
        met += (x == y).all(1).any()
    assert abs(met / 400 - (1 - (1 - 0.85**6) ** 2)) < 0.08


def test_settle_joins_what_can_be_joined():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(1 << 60, size=300, dtype=np.uint64)) for _ in range(4)]
    sets = [np.sort(np.concatenate([b[k:], rng.integers(1 << 60, size=k, dtype=np.uint64)])) for b in base for k in range(0, 25, 4)]
    fp = np.arange(len(sets))
    rings = np.stack([np.frombuffer(forest.ring(s, 210), np.uint8) for s in sets])
    groups = forest.Sets()
    for a, b in forest.settle(fp, fp, rings, sets, (17, 20), 6, 0):
        assert a // 7 == b // 7
        groups.join(a, b)
    assert [groups.root(i) for i in range(len(sets))] == [i // 7 * 7 for i in range(len(sets))]


def test_a_pair_is_taken_up_once():
    """Over all orders, each pair that shares regions is a candidate in one of them."""
    rng, depth, n = np.random.default_rng(9), 2, 10
    base = rng.integers(1 << 60, size=200, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[k:], rng.integers(1 << 60, size=k, dtype=np.uint64)])) for k in range(12)]
    rings = np.stack([np.frombuffer(forest.ring(s, depth * n), np.uint8) for s in sets])
    seen, shared = [], set()
    for tree in range(n):
        prefix = [r[tree * depth : tree * depth + depth].tobytes() for r in rings]
        for p in set(prefix):
            own = np.array([i for i in range(12) if prefix[i] == p])
            shared |= {(a, b) for a in own.tolist() for b in own.tolist() if a < b}
            found = list(forest.candidates(own, rings[own], (17, 20), depth, tree))
            seen += list({tuple(sorted((int(own[i]), int(own[j])))) for i, js in found for j in js})
    assert len(seen) == len(set(seen)) and set(seen) <= shared and len(seen) > 30
