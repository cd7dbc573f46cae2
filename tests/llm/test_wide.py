"""Near-duplicates by deletion variants of a wide SimHash, against brute force."""

import numpy as np
import pytest

from factorloom.llm import wide

from test_forest import brute, corpus, found, table


@pytest.mark.parametrize("options", [{}, {"exact": 6, "large": 4}])
def test_near_duplicates(spark, options):
    rows = [(i if i % 9 else None, t) for i, t in enumerate(corpus(seed=3))]
    assert found(wide.near_duplicates(table(spark, rows), similarity=(4, 5), **options)) == brute(rows, part=80)


def test_few_shingles(spark):
    """Sets of 4 and 5 shingles, in which more bits differ: all pairs are found."""
    rows = []
    for i in range(300):
        text = " ".join(f"w{i}x{j}" for j in range(9))
        rows += [(2 * i, text.rsplit(" ", 1)[0]), (2 * i + 1, text)]
    got = wide.near_duplicates(table(spark, rows), similarity=(4, 5))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(i, i - i % 2) for i, _ in rows}


def test_large_group(spark, monkeypatch):
    """A group of near copies that one neighbour each doesn't join whole, beside texts just below the similarity."""
    monkeypatch.setattr(wide, "_BROAD", 8)
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(w if j != at else "other" for j, w in enumerate(words))) for i, at in enumerate(rng.integers(200, size=60))]
    rows += [(100 + i, " ".join(w if j % 23 != i % 23 else f"x{i}" for j, w in enumerate(words))) for i in range(40)]
    assert found(wide.near_duplicates(table(spark, rows), similarity=(4, 5), large=16)) == brute(rows, part=80)


def test_none(spark):
    assert wide.near_duplicates(table(spark, [])).count() == 0


def test_differing_bits():
    rng = np.random.default_rng(5)
    for a, b, common in ((4, 5, 4), (12, 15, 12), (90, 90, 80)):
        share = []
        for _ in range(60):
            h = rng.integers(1 << 63, size=a + b - common, dtype=np.uint64)
            x, y = (np.frombuffer(wide.fingerprint(s, 2048), np.uint64) for s in (h[:a], h[a - common :]))
            share.append(np.bitwise_count(x ^ y).sum() / 2048)
        assert abs(np.mean(share) - wide.differing(a, b, common)) < 0.006
    assert wide.most_differing((4, 5))[1] == wide.differing(4, 5, 4)
    assert all((1 - (1 - p) ** (2 + wide.REST) * (1 + wide.REST * p / (1 - p))) ** wide.segments(p, 2) <= wide.MISSED for p in wide.most_differing((4, 5)))


def test_each_pair_of_a_variant_once(monkeypatch):
    monkeypatch.setattr(wide, "_BROAD", 16)
    rng, m = np.random.default_rng(6), 600
    few, hi, lo = rng.integers(2, size=m) << wide.REST, rng.integers(8, size=m), np.zeros(m, np.int64)
    for root in (np.arange(m), np.where(rng.random(m) < 0.5, 7, rng.integers(100, 130, size=m))):
        for mask in (0xFFF, 0x1F, 3):
            rest = rng.integers(1 << wide.REST, size=m) & mask
            got = [tuple(sorted(p)) for i, j, _ in wide.variants(rest | few, lo, hi, root, (1, 2)) for p in zip(i.tolist(), j.tolist(), strict=True)]
            both = np.where((few[:, None] & few[None, :]) > 0, 2, 1)
            want = (np.bitwise_count(rest[:, None] ^ rest) <= 1) & (root[:, None] != root) & (np.bitwise_count(hi[:, None] ^ hi) <= both)
            assert len(got) == len(set(got)) and set(got) == set(zip(*(x.tolist() for x in np.nonzero(np.triu(want, 1))), strict=True))


def test_the_pipeline_takes_candidates_from_simhash(spark, monkeypatch):
    """The stage asks the fingerprints: without shared variants, no text that differs is linked."""
    pipeline = pytest.importorskip("corpus_pipeline")
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text), (2, text + " more"), (3, text)]
    assert {(r.doc_id, r.component_id) for r in pipeline.linked(table(spark, rows)).collect()} == {(1, 1), (2, 1), (3, 1)}
    monkeypatch.setattr(wide, "segments", lambda differ, exact: 1)
    monkeypatch.setattr(wide, "furthest", lambda differ, bits: -1)
    assert {(r.doc_id, r.component_id) for r in pipeline.linked(table(spark, rows)).collect()} == {(1, 1), (2, 2), (3, 1)}


def test_rows_grow_with_texts(spark, monkeypatch):
    """Texts just below the similarity, nearly all pairs of which share a segment: no table has a row for each pair."""
    rng, rows, made = np.random.default_rng(7), [], {}
    words = [f"w{i}" for i in range(100)]
    for i in range(300):
        own = list(words)
        for j, at in enumerate(rng.choice(np.arange(4, 96), 2, replace=False)):
            own[at] = f"x{i}y{j}"
        rows.append((i, " ".join(own)))
    written = wide.written

    def counted(df, name, *args):
        out = written(df, name, *args)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(wide, "written", counted)
    assert found(wide.near_duplicates(table(spark, rows), similarity=(4, 5), large=64)) == brute(rows, part=80)
    assert max(made.values()) <= wide.FIRST_SEGMENTS * (wide.NEIGHBOURS + 1) * len(rows), made  # of 44,850 pairs


def test_joined_roots_are_not_compared_again():
    m = 2000
    zero, root, pairs = np.zeros(m, np.int64), np.arange(m), 0
    for i, _, _ in wide.variants(zero, zero, zero, root, (1, 2)):
        pairs += len(i)
        root[:] = 0
    assert 0 < pairs < m


def test_joined():
    """Roots that near sketches hold together, as all pairs give them; a third word of the sketch tells some apart."""
    rng, m = np.random.default_rng(8), 500
    rest, (lo, hi, more) = rng.integers(64, size=m), rng.integers(4, size=(3, m))
    more[: m // 2] |= 0xFF00
    root = np.where(rng.random(m) < 0.3, rng.integers(5, size=m), 10 + np.arange(m))
    near = (np.bitwise_count(rest[:, None] ^ rest) <= 1) & (sum(np.bitwise_count(x[:, None] ^ x) for x in (lo, hi, more)) <= 1)
    want, got = wide.Sets(), wide.Sets()
    for i, j in zip(*np.nonzero(near), strict=True):
        want.join(int(root[i]), int(root[j]))
    links = wide.joined(rest, lo, hi, more, root, (1, 1))
    assert all(got.join(*x) for x in links)
    assert [got.root(int(x)) for x in root] == [want.root(int(x)) for x in root]


def test_shared():
    """Members that a set of another root has: what pairs of different roots can have in common, at most."""
    rng = np.random.default_rng(9)
    sets, root = [np.unique(rng.integers(60, size=n)).astype(np.uint64) for n in rng.integers(1, 12, size=40)], rng.integers(8, size=40)
    want = [sum(any(x in t for t, s in zip(sets, root, strict=True) if s != r) for x in own) for own, r in zip(sets, root, strict=True)]
    assert wide.shared(sets, root).tolist() == want
