"""Each operator against a brute-force version, on small tables with every odd case."""

import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from factorloom.llm import blocks, bpe, brown, common, fingerprints, lines, mixing, neighbours, quality, queries, simhash, substrings, token_store

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, block bigint, part int, id string, data binary, fp bigint, size bigint, target double, rank int, score double"
WORDS = ["the", "of", "Und", "éauré", "thering", "ention", "a", "ing.", "is,", "x1", "zu", "nicht"]


def texts():
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [". ".join(say(9) for _ in range(6)) + ".\n" + say(30) for _ in range(8)]
    near = [b.replace("the", "thy", 1) for b in base[:3]]
    return [None, "", " \n\t ", "one", "one", *base, *near, base[0], base[1], say(30_000), "\n\n\n", "日本語 text 😀 é", base[2] + "\n" + base[3], "a" * 400, "a" * 250, "<|endoftext|> it's", "x\x1cy"]


def rows():
    out = [(i * 3, t, "en", ["s1", "s2", None][i % 3] if i % 4 else "s1", None, i, -1, "x", b"1", 7, 9, 0.5, 2, 0.1) for i, t in enumerate(texts())]
    return out + [out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark):
    queries.ship(spark)
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of null in every column beside one good row."""
    return spark.createDataFrame([(None,) * 14, (5, "a good text of some words", *[None] * 12), (None,) * 14], SCHEMA)


def by_id(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def ordered():
    """(id, text) in ascending order with repeated rows, as the operators see them."""
    return sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: x[0])


def sha(b):
    return hashlib.sha256(b).hexdigest()


def x64(s):
    return f"{xxhash.xxh64_intdigest(s.encode(), 42):016X}"


def brute_tree(text):
    """(root, [(section hash, [(paragraph hash, leaves)])]), and the string of the whole tree."""
    pieces = re.findall(r"[^.!?\n]{1,48}[.!?]*\n*|[.!?]+\n*|\n+", text)
    tree, paragraphs, leaves = [], [], ""
    for i, p in enumerate(pieces):
        h = x64(p)[-12:]
        end = "." if not p.endswith("\n") else ";" if p.endswith("\n\n") or h[-1] in "08" else ","
        leaves += h + end
        if end != "." or i == len(pieces) - 1:
            paragraphs.append((x64(leaves), leaves))
            leaves = ""
            if end == ";" or i == len(pieces) - 1:
                tree.append((x64("".join(h for h, _ in paragraphs)), paragraphs))
                paragraphs = []
    root = x64("".join(h for h, _ in tree))
    return root, tree, root + ":" + "".join(f"S{h}" + "".join(f"P{a}{b}" for a, b in ps) for h, ps in tree)


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    names = lambda ps: {x for _, leaves in ps for x in re.split("[.,;]", leaves) if x}
    every = [names([p for _, ps in t[1] for p in ps]) for t in (a, b)]
    left = []
    for x, y in ((a, b), (b, a)):
        left.append([(h, str(ps), ps) for h, ps in x[1] if (h, ps) not in y[1]])
    paragraphs = [{(h, v) for _, _, ps in part for h, v in ps} for part in left]
    leaves = [names(paragraphs[0] - paragraphs[1]), names(paragraphs[1] - paragraphs[0])]
    return 1 - (len(leaves[0] - leaves[1]) + len(leaves[1] - leaves[0])) / (len(every[0]) + len(every[1]))


def test_fingerprints(docs, empty, odd):
    got = fingerprints.document_fingerprints(docs).collect()
    order = ordered()[::-1]
    want = []
    for i, (k, t) in enumerate(order):
        nxt, half = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        own, new, other = brute_tree(t), brute_tree(edited), brute_tree(nxt)
        want.append((k, len(t), sha(edited.encode()), own[2], new[2], round(brute_likeness(own, new), 9), round(brute_likeness(own, other), 9)))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)
    assert len({r.fingerprint for r in got}) == len({t for _, t in order})
    assert fingerprints.document_fingerprints(empty).count() == 0 and fingerprints.document_fingerprints(odd).count() == 3
    one = fingerprints.document_fingerprints(odd.where("doc_id = 5")).first()
    assert one.near_next == 1.0


def test_fingerprints_of_many_nulls_and_rows_of_one_id(spark):
    """One id, and null, with a third of all rows each: cut by the text's hash, in the order of the whole."""
    rng = random.Random(6)
    data = [(i, f"text {i} " + "x" * rng.randrange(40)) for i in range(60)] + [(7, f"seven {i}") for i in range(60)] + [(None, f"none {i}") for i in range(60)]
    got = fingerprints.document_fingerprints(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)).collect()
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(data, key=lambda x: (x[0] is not None, x[0] or 0, signed(x[1])), reverse=True)
    edited = []
    for i, (k, t) in enumerate(order):
        half = len(t) // 2
        edited.append((str(k), sha((t[: len(t) - half] + order[(i + 1) % len(order)][1][:half]).encode())))
    assert sorted((str(r.doc_id), r.edited_sha256) for r in got) == sorted(edited)


def test_fingerprint_locates_edits(spark):
    a, b = "First part.\n\nMiddle part.\nAnd more.\n\nThird part.", "First part.\n\nMiddle pert.\nAnd more.\n\nThird part."
    d = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.fingerprint(fingerprints.leaves(F.col("a"))).alias("a"), fingerprints.fingerprint(fingerprints.leaves(F.col("b"))).alias("b"))
    at = d.select(fingerprints.differing(F.col("a"), F.col("b")).alias("x"), fingerprints.differing(F.col("a"), F.col("a")).alias("y")).first()
    assert [(r.section, r.paragraphs) for r in at.x] == [(1, [0])] and at.y == []


def test_quality(spark, docs, empty, odd):
    rng = random.Random(1)
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + ".", 1) for i in range(0, 300, 2)]
    junk = [(i, " ".join(rng.choice(WORDS) + "$$$" for _ in range(60)), 0) for i in range(1, 301, 2)]
    d = spark.createDataFrame(good + junk, "doc_id int, text string, quality int")
    r = quality.quality_scores(d, d.select("doc_id", "quality")).join(d, "doc_id").toPandas()
    assert (r.predicted == r.quality).mean() > 0.98 and r.score.between(0, 1).all()
    assert r.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]
    labels = spark.createDataFrame([(None, 1), (3, None), (4, 1)], "doc_id bigint, quality int")
    for df in (docs, empty, odd):
        out = quality.quality_scores(df, labels)
        assert out.count() == df.count() and out.where("score is null or score < 0 or score > 1").count() == 0


@pytest.mark.parametrize("n", [2, 3, 5, 10])
def test_quality_of_few_labels(n):
    """Too few rows for a tree to split: the smoothed share of label 1."""
    y = np.array([i % 2 for i in range(n)], float)
    rules = quality.fit_rules(np.arange(n, dtype=float)[:, None], y, ["a"])
    share = (y.sum() + 1) / (n + 2)
    if n < 6:
        assert rules.rules == () and math.isclose(1 / (1 + math.exp(-rules.bias)), share)
    assert quality.fit_rules(np.zeros((n, 1)), y, ["a"]).rules == ()


def test_compiled_rules_are_the_fitted_ones(spark):
    """Column expressions against the rules in numpy, over statistics counted in plain Python."""
    rng = random.Random(3)
    some = [t or "" for t in texts() if t is None or len(t) < 5000] + ["".join(rng.choice("aB1 .,|!\n\u00e9\u00c9\u65e5$") for _ in range(rng.randint(1, 200))) for _ in range(60)]

    def plain(t):
        import unicodedata

        n, words = max(len(t), 1), re.split(r"[ \t\n\x0b\f\r]+", t)
        words = [w for w in words if w]
        count, kind = max(len(words), 1), [unicodedata.category(c) for c in t]
        symbols = sum(not (k[0] in "LN" or c in ".,;:!?'-" or c in " \t\n\x0b\f\r") for c, k in zip(t, kind, strict=True))
        return [len(t), n / count, len(set(words)) / count, kind.count("Lu") / n, sum(k[0] == "L" for k in kind) / n, sum(c in "0123456789" for c in t) / n, symbols / n, t.count("|") / count, t.count(".") / count, t.count(",") / count, t.count("!") / count, count / (t.count("\n") + 1)]

    x = np.array([plain(t) for t in some])
    y = (x[:, 4] + x[:, 7] > np.median(x[:, 4] + x[:, 7])).astype(float)
    rules = quality.fit_rules(x, y, list(quality.statistics(F.lit(""))))
    assert len(rules.rules) > 3
    z = np.full(len(x), rules.bias)
    names = list(quality.statistics(F.lit("")))
    for weight, conditions in rules.rules:
        z += weight * np.all([(x[:, names.index(k)] > at) if up else (x[:, names.index(k)] <= at) for k, up, at in conditions], axis=0)
    got = quality.score_quality(spark.createDataFrame(list(enumerate(some)), "i int, text string"), rules).orderBy("i").collect()
    assert np.allclose([r.score for r in got], 1 / (1 + np.exp(-z)))


def brute_nearest(ids, x, q, k):
    s = neighbours.exact(x, x[q])
    return [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]


@pytest.mark.parametrize(("cell", "sample", "tree"), [(8192, 2048, 1 << 17), (64, 40, 1 << 17), (64, 40, 4), (10, 0, 64)])
def test_neighbours(spark, monkeypatch, cell, sample, tree):
    """Ties (60 equal vectors), odd rows, one cell and many, cells cut by a hash, with and without a sample."""
    for name, value in (("CELL_ROWS", cell), ("SAMPLE", sample), ("TREE_SAMPLE", tree), ("LEAF", 16)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8))
    x[300:360] = x[0]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [1.0, None] + [0.0] * 6), (1003, [float("nan")] * 8), (1004, [1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("norm", F.lit("x"))
    hit, ids = 0, np.arange(400)
    got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, 20).toPandas().sort_values(["query_id", "rank"])
    assert sorted(got.query_id.unique()) == list(range(0, 400, 20))
    for q, g in got.groupby("query_id"):
        hit += len(set(brute_nearest(ids, x, q, 20)) & set(g.vec_id))
        assert (g.score.to_numpy() == neighbours.exact(x[g.vec_id], x[q])).all() and g["rank"].tolist() == list(range(1, 21))
    assert hit / 400 >= 0.95
    top = neighbours.nearest(df, F.col("vec_id") == 0, 5).orderBy("rank").toPandas()
    assert top.vec_id.tolist() == [300, 301, 302, 303, 304]


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 2.0])], "vec_id bigint, embedding array<double>")
    assert neighbours.nearest(df, F.col("vec_id") == 0, 20).count() == 2
    assert neighbours.nearest(df.where("false"), F.col("vec_id") == 0).count() == 0
    assert neighbours.nearest(df, F.lit(False)).count() == 0
    none = spark.createDataFrame([(1, None), (None, None)], "vec_id bigint, embedding array<double>")
    assert neighbours.nearest(none, F.col("vec_id") == 1).count() == 0


def test_neighbour_search_leaves_most_vectors_out():
    """Isotropic vectors, the hardest case: at most a fifth is verified at a recall of 0.95."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids, queries_ = np.arange(len(x)), np.arange(0, len(x), 300)
    space = neighbours.Space(64, 1.0, neighbours.PROJECTIONS)
    cell = neighbours.Cell(space, ids, x, neighbours.LEAF)
    sample = x[queries_] @ x[: neighbours.SAMPLE].T
    sample[queries_[:, None] == ids[None, : neighbours.SAMPLE]] = -1
    best = cell.search(queries_, x[queries_], np.sort(sample, 1)[:, -20], 20, space.limit(neighbours.CONFIDENCE))
    hit = sum(len(set(brute_nearest(ids, x, q, 20)) & set(best.ids[i].tolist())) for i, q in enumerate(queries_))
    assert hit / (20 * len(queries_)) >= 0.95 and cell.verified / (len(x) * len(queries_)) <= 0.2


def test_token_files(docs, empty, odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    tk = Tokenizer.from_file(path)
    manifest, dictionary = token_store.save(docs, path)
    got = token_store.load(manifest, dictionary).orderBy("start").collect()
    want = [np.array([*tk.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes() for _, t in ordered()]
    assert [r.doc_id for r in got] == [k for k, _ in ordered()] and [bytes(r.ids) for r in got] == want
    assert [r.start for r in got] == np.r_[0, np.cumsum([len(w) // 4 for w in want])[:-1]].tolist()
    f = token_store.TokenFile(manifest.first().path, dictionary)
    assert sum(r.documents for r in manifest.collect()) == len(want)
    assert f.find(int(f.ids[0])).tobytes() == want[[k for k, _ in ordered()].index(int(f.ids[0]))]
    with pytest.raises(KeyError):
        f.find(1)
    with pytest.raises(ValueError):
        token_store.TokenFile(manifest.first().path, b"other")
    assert token_store.load(*token_store.save(empty, path)).count() == 0
    assert token_store.load(*token_store.save(odd, path)).where("doc_id is null and n_tokens = 1").count() == 2


def test_token_ids_are_the_librarys():
    """Strings of marks, letters that grow when lower-cased, special tokens, every kind of space."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_BPE)
    tokenizer, words, rng = Tokenizer.from_file(path), token_store._words(path), random.Random(1)
    marks = [*"abcdeXYZIi'\"<.,!?-13K", "\u0130", "\u0131", "\u00df", "\u1e9e", "\u03a3", "\u03c2", "e\u0301", "\u0301", "\u0307", "\u0338", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "\u00b2", "\u65e5", "\u0e01\u0e47", "\ufb01", "\u2167", "\u00aa", "\u02b0", "\u212a", "\u212b", "\u1100\u1161", "\uac00", "\u0345", "\u01c5", "\U0001f600", "\u200d", "\u00ad", "\x00", "\x1c", "\x1f"]
    spaces = [*" \n\t\r\x0b\x0c\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000\u200b\u180e", *map(chr, range(0x2000, 0x200B))]
    for _ in range(20):
        some = ["".join(rng.choice(spaces) if rng.random() < 0.15 else rng.choice(marks) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
        assert [words.ids(t).tolist() for t in some] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_brown(docs, empty, odd):
    got = {r.doc_id: r for r in brown.score_documents(docs).collect()}
    words = [(k, t.encode().translate(brown._LOWER).split()) for k, t in ordered()]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in words}
    c, n_docs = Counter(), 0
    for k, w in words:
        if not held[k]:
            c.update(w)
            n_docs += 1
    n, v = sum(c.values()) + n_docs, len(c) + 1
    for k, w in words:
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((n_docs + 1) / (n + v + 1))
        r = got[k]
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in w) + 1 and r.train_tokens == n and r.held_out == held[k]
        assert math.isfinite(r.score) and r.score <= 0
    assert brown.score_documents(empty).count() == 0 and brown.score_documents(odd).count() == 3
    none = brown.score_documents(odd, held=F.lit(True)).collect()
    assert all(r.score == 0 and r.base_score == 0 and r.n_known == 0 for r in none)


def brute_brown(words, held, classes, sweeps):
    """The model in plain Python: counts, seeds, exchange sweeps, transitions, scores."""
    count = Counter(x for k, w in words if not held[k] for x in w)
    ends = sum(not held[k] for k, _ in words)
    top = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: classes - 2]]
    cls = {w: top.index(w) + 1 if w in top else classes - 1 for w in count}

    def pairs():
        m = np.zeros((classes, classes))
        for k, w in words:
            if not held[k]:
                seq = [0, *(cls[x] for x in w), 0]
                for a, b in zip(seq, seq[1:], strict=False):
                    m[a, b] += 1
        return m

    for _ in range(sweeps):
        m = pairs()
        size = m.sum(0)
        expect = brown._SMOOTH * np.outer(m.sum(1), size) / m.sum() + 1e-9
        near = {w: (np.zeros(classes), np.zeros(classes)) for w in count}
        for k, w in words:
            if not held[k]:
                seq = [0, *(cls[x] for x in w), 0]
                for i, x in enumerate(w):
                    near[x][0][seq[i]] += 1
                    near[x][1][seq[i + 2]] += 1
        moved = {}
        for w, (left, right) in near.items():
            best = []
            for c in range(1, classes):
                if size[c] > 0:
                    out = c == cls[w]
                    a = np.log(np.maximum(m[:, c] - left * out, 0) + expect[:, c])
                    b = np.log(np.maximum(m[c] - right * out, 0) + expect[c])
                    n = count[w]
                    best.append((left @ a + right @ b - 2 * n * math.log(max(size[c] - (n if out else 0), 1)), -c))
            moved[w] = -max(best)[1]
        cls = moved
    m = pairs()
    vocab = np.bincount([0, *cls.values()], minlength=classes)
    move, size, unknown = brown.transitions(m, vocab)
    out, total = {}, 0.0
    for k, w in words:
        before, score = 0, 0.0
        for x in [*w, None]:
            if x is None:
                score += move[before, 0] + math.log10(ends - brown.DISCOUNT) - math.log10(size[0])
            elif count[x]:
                score += move[before, cls[x]] + math.log10(count[x] - brown.DISCOUNT) - math.log10(size[cls[x]])
                before = cls[x]
            else:
                score += unknown[before]
                before = classes
        out[k] = score
        total += 0 if held[k] else score
    return out, total


def test_brown_scores(spark):
    """Every score against the model in plain Python; sweeps make the training text likelier."""
    rng = random.Random(2)
    kinds = [[f"{c}{i}" for i in range(12)] for c in "abc"]
    data = [(i, " ".join(rng.choice(kinds[(j + i) % 3] if rng.random() < 0.9 else kinds[0]) for j in range(rng.randint(0, 40)))) for i in range(120)]
    words = [(k, t.encode().split()) for k, t in data]
    held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in data}
    df = spark.createDataFrame(data, "doc_id bigint, text string").repartition(3)
    totals = []
    for sweeps in (0, 1, 3):
        want, total = brute_brown(words, held, 6, sweeps)
        got = {r.doc_id: r.score for r in brown.score_documents(df, classes=6, sweeps=sweeps).collect()}
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
        totals.append(total)
    assert totals[0] < totals[1] <= totals[2]


def test_brown_probabilities_sum_to_one():
    m = np.array([[0, 6, 4], [5, 2, 3], [5, 2, 0]])
    vocab = np.array([1, 3, 2])
    move, size, unknown = brown.transitions(m, vocab)
    for before in range(4):
        known = sum(10 ** move[before, k] * (size[k] - brown.DISCOUNT * vocab[k]) / size[k] for k in range(3))
        assert math.isclose(known + 10 ** unknown[before], 1.0)


def brute_simhash(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, empty, odd):
    fps = [(k, brute_simhash(t)) for k, t in ordered()]
    s = common.Sets()
    for a, x in fps:
        for b, y in fps:
            if (x ^ y).bit_count() <= 2:
                s.join(a, b)
    assert by_id(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted((k, f"{x:016x}", s.root(k)) for k, x in fps)
    assert simhash.near_duplicates(empty).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(odd).where("doc_id is null").collect()} == {None}


def test_simhash_large_group(spark):
    rng = random.Random(9)
    fps = list({rng.getrandbits(64) & 0xF | (0xABC << 40) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(32)) for _ in range(1500)})
    sets = common.Sets()
    simhash._LARGE, old = 16, simhash._LARGE
    low = np.array(sorted({f & 0xFFFFFFFF for f in fps}), np.uint64)
    simhash._pairs(low, 2, sets, ((0, 11), (11, 11), (22, 10)))
    simhash._LARGE = old
    want = common.Sets()
    for i, a in enumerate(low.tolist()):
        for b in low[:i].tolist():
            if (a ^ b).bit_count() <= 2:
                want.join(a, b)
    assert [sets.root(x) for x in low.tolist()] == [want.root(x) for x in low.tolist()]


def brute_jaccard(data):
    """Roots of the components of (id, text) linked at a similarity of 0.8 over five words."""
    sets, joined = {}, common.Sets()
    for k, t in data:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    for a, x in sets.items():
        for b, y in sets.items():
            if a < b and 5 * len(x & y) >= 4 * len(x | y):
                joined.join(a, b)
    return joined


def test_near_dedup_stage(spark, docs, empty, odd):
    """Near copies that differ by more bits than op6 allows; chains of them; one group of many."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    say = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    data = []
    for size in (40, 90, 200, 200, 120, 60):
        base = say(size)
        for _ in range(25):
            edited = list(base)
            for _ in range(rng.randint(0, max(1, size // 20))):
                edited[rng.randrange(size)] = f"x{rng.randrange(1000)}"
            data.append(" ".join(edited))
            base = edited if size == 120 else base
    rng.shuffle(data)
    data = list(enumerate(data))
    want = brute_jaccard(data)
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in data], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(4)
    assert by_id(pipeline.linked(df), "doc_id", "component_id") == [(k, want.root(k)) for k, _ in data]
    kept = pipeline.STAGES[2][1](spark, df, "")
    assert {r.doc_id for r in kept.collect()} == {want.root(k) for k, _ in data}
    want = brute_jaccard(ordered())
    assert by_id(pipeline.linked(docs), "doc_id", "component_id") == [(k, want.root(k)) for k, _ in ordered()]
    assert pipeline.linked(empty).count() == 0
    assert {r.component_id for r in pipeline.linked(odd).where("doc_id is null").collect()} == {None}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(100, x) for x in range(101, 130)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint"), "test").collect()}
    want = common.Sets()
    for a, b in edges:
        want.join(a, b)
    assert got == {x: want.root(x) for x in want.up if want.root(x) != x}


def test_components_never_end_early(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a bigint, b bigint")
    with pytest.raises(RuntimeError):
        common.components(chain, "test", rounds=1)


def van_der_corput(i):
    return int(bin(i)[:1:-1], 2) / 2 ** (i.bit_length())


def brute_mix(sizes, block_words, point=van_der_corput):
    """What the slots give: how often each word of each source's line is taken, and at which slot first."""
    plan = mixing.source_plan(list(sizes.items()), block_words=block_words)
    slots = sum(p[7] for p in plan)
    own = {p[0]: [] for p in plan}
    for slot in range(1, slots + 1):
        u = point(slot)
        own[next(p[0] for p in plan if p[5] <= u < p[6])].append(slot)
    used, first = {}, {}
    for i, s, n, _, blocks, _, _, whole, part in plan:
        used[s], first[s] = np.zeros(n, int), np.full(n, 10**9)
        edges = np.cumsum([0] + [n // blocks + (b < n % blocks) for b in range(blocks)]) if blocks else [0]
        got, at = len(own[i]), [*own[i], slots + 1 + i]
        take = [(r, None) for r in range(got)]
        if got < whole:
            take += [(got, None)]
        elif got in (whole, whole + 1):
            take = take[:whole] + [(whole, part)]
        else:
            take = take[:-1]
        for r, words in take:
            if blocks and r < 3 * blocks:
                lo = edges[r % blocks]
                span = slice(lo, edges[r % blocks + 1] if words is None else lo + words)
                used[s][span] += 1
                first[s][span] = np.minimum(first[s][span], at[r])
    return used, first


@pytest.mark.parametrize("block_words", [8, 256])
def test_mixing(docs, empty, odd, block_words):
    got = mixing.mix(docs, block_words=block_words).toPandas()
    sizes = {}
    for r in rows():
        sizes.setdefault(r[3], []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")))
    total = {k: sum(v) for k, v in sizes.items()}
    goal = mixing.targets(list(total.items()))
    assert math.isclose(sum(goal.values()), sum(total.values()))
    used, first = brute_mix(total, block_words)
    for s, g in got.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert sorted(g["size"]) == sorted(sizes[s]) and set(g.source_size) == {total[s]}
        assert abs(g.taken.sum() - goal[s]) <= 8 * block_words and (g.taken <= 3 * g["size"]).all()
        signed = g.sort_values(["row_hash", "row_check"])  # the source's line: what the schedule takes of each row
        ends = np.cumsum(signed["size"])
        alike = {}
        for h, n, slot, lo, hi in zip(signed.row_hash, signed.taken, signed.first_slot, ends - signed["size"], ends, strict=True):
            x = alike.setdefault(h, [0, 0, [], []])
            x[0] += n
            x[1] += used[s][lo:hi].sum()
            x[2].append(slot if n else 10**9)
            x[3].append(min(first[s][lo:hi], default=10**9))
        assert all(a == b and min(x) == min(y) for a, b, x, y in alike.values())
    again = mixing.mix(docs.repartition(2), block_words=block_words).toPandas()
    assert sorted(zip(got.doc_id, got.taken, got.slots, strict=True)) == sorted(zip(again.doc_id, again.taken, again.slots, strict=True))
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() == 3
    assert mixing.targets([("a", 1), ("b", 1000), (None, 10)]) == {"a": 3.0, "b": 978.0, None: 30.0}
    assert mixing.leading_words(" a  b\nc ", 2) == " a  b"
    taken = mixing.taken_text(docs, ("doc_id", "text"), block_words=block_words).collect()
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in taken) == got.taken.sum()
    whole = dict(ordered())
    assert all(whole[r.doc_id].startswith(r.text) for r in taken)
    slot = {k: g.first_slot.min() for k, g in mixing.mix(docs, block_words=block_words, alike=("doc_id", "text")).toPandas().groupby("doc_id")}
    order = list(dict.fromkeys(r.doc_id for r in taken))
    assert [slot[k] for k in order] == sorted(slot[k] for k in order)  # rows come in the order of the slots
    assert mixing.taken_text(empty, ("doc_id", "text")).count() == 0 and mixing.taken_text(odd, ("doc_id", "text")).count() == 1


def test_any_first_slots_hold_sources_to_their_shares(spark):
    plan = mixing.source_plan([("a", 50_000), ("b", 90_000), ("c", 700), ("d", 300_000)], block_words=100)
    frame = spark.createDataFrame(plan, "__s int, source string, source_size bigint, target double, __blocks bigint, __from double, __to double, __whole bigint, __part bigint")
    dealt = {r["id"]: r["__s"] for r in mixing.schedule(frame, 4000, 4).collect()}
    assert sorted(dealt) == list(range(1, 4001))
    seen = Counter()
    for n in range(1, 4001):
        seen[dealt[n]] += 1
        assert all(abs(seen[p[0]] - n * (p[6] - p[5])) <= math.log2(n) + 1 for p in plan)


def test_the_schedule_decides(docs, monkeypatch):
    """Other points: other slots, and other words taken."""
    before = mixing.mix(docs, block_words=8).toPandas()
    monkeypatch.setattr(mixing, "van_der_corput", lambda slot: (slot % 997) / F.lit(997.0) * F.lit(0.5))
    after = mixing.mix(docs, block_words=8).toPandas()
    key = lambda t, c: sorted(zip(t.row_hash, t[c].fillna(-1), strict=True))
    assert key(before, "first_slot") != key(after, "first_slot") and key(before, "taken") != key(after, "taken")


@pytest.mark.parametrize("sizes", [[1, 6, 64, 70, 200, 5000], [10, 100_000], [6] * 2000, [3, 0, 0, 1], [40_000, 90_000, 2_000, 700]])
def test_mixing_comes_near_targets_of_any_size(spark, sizes):
    data = [(i, " ".join(["w"] * n), f"s{i:05d}") for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(4)).collect()
    assert len(got) == len(sizes)
    block = mixing.block_size(sum(sizes))
    assert all(abs(r.taken - r.target) <= max(1, 2 * block) and r.taken <= 3 * r["size"] for r in got)
    assert all((r.taken > 0) == (r["size"] > 0) for r in got)


def brute_repeats(data, length):
    seen, want = set(), []
    for k, t in data:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(b[i : i + length])
        edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(int)))
        want.append((k, len(b), sha(np.frombuffer(b, np.uint8)[~gone].tobytes()), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))))
    return sorted(want)


def removed(df):
    return sorted((r.doc_id, r.n_bytes, sha(bytes(r.kept)), [(s["start"], s["end"]) for s in r.spans]) for r in df.collect())


@pytest.mark.parametrize(("length", "digit", "large"), [(100, 32, 256), (100, 32, 0), (400, 32, 1)])
def test_substrings(docs, empty, odd, length, digit, large):
    assert removed(substrings.remove_repeats(docs, length=length, digit=digit, large=large)) == brute_repeats(ordered(), length)
    if large == 0:
        assert substrings.remove_repeats(empty).count() == 0 and substrings.remove_repeats(odd).count() == 3


def around(data):
    """One short passage in every text, whose surroundings differ, repeat in part or in whole."""
    rng = random.Random(7)
    say = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    line, heads, tails = say(60), [say(50) for _ in range(4)], [say(50) for _ in range(4)]
    return [(i, say(20) + rng.choice(heads)[rng.randrange(40) :] + line + rng.choice(tails)[: rng.randrange(50)] + say(30)) for i in range(data)]


def test_substrings_of_a_line_that_all_have(spark):
    data = around(200)
    got = substrings.remove_repeats(spark.createDataFrame(data, "doc_id bigint, text string").repartition(5), large=8)
    assert removed(got) == brute_repeats(data, 100)


def by(key, tables):
    """Rows of tables grouped by a column, as the reducers get them."""
    pa = substrings.pa
    rows = [r for t in tables for r in t.to_pylist()]
    schema = tables[0].schema
    for t in tables[1:]:
        schema = pa.unify_schemas([schema, t.schema])
    for k in sorted({r[key] for r in rows}):
        yield pa.Table.from_pylist([{n: r.get(n) for n in schema.names} for r in rows if r[key] == k], schema)


@pytest.mark.parametrize(("length", "digit", "large", "chunk", "block", "parts"), [(100, 32, 256, 1 << 20, 16 << 20, 3), (100, 32, 8, 300, 1500, 5), (40, 16, 2, 1000, 4000, 2), (9, 8, 4, 64, 500, 1), (300, 20, 1, 512, 1 << 20, 4)])
def test_substrings_across_seams(spark, monkeypatch, length, digit, large, chunk, block, parts):
    """The passes in this process, with blocks and chunks so small that all texts cross them."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    monkeypatch.setattr(substrings, "_CHUNK", chunk)
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    substrings._powers.cache_clear()
    pa, arrow = substrings.pa, lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    data = [*around(60), (100, ordered()[5][1] * 3), (101, None), (102, "ab" * 900), (103, "x" * 350 + ordered()[6][1])]
    body, runs, answer = arrow("block bigint, ids array<bigint>, data binary"), arrow("block bigint, part int, ids array<bigint>, data binary"), arrow("block bigint, part int, kind int, data binary")
    request = arrow("block bigint, part int, kind int, ids array<bigint>, data binary, text binary")
    whole = [*blocks.texts(iter([pa.RecordBatch.from_pydict({"id": [i for i, _ in data], "text": pa.array([t for _, t in data], pa.string())})]), body)]
    found = [pa.Table.from_batches([b]) for b in substrings._scan(iter(whole), length, digit, parts, runs)]
    dealt = [substrings._dealt(t, large, answer) for t in by("part", found)]
    text = [pa.Table.from_batches([b]).append_column("part", pa.array([-1], pa.int32())).append_column("kind", pa.array([-1], pa.int32())) for b in whole]
    some = [t.filter(pa.compute.greater(t["kind"], 0)) for t in dealt]
    asked = [substrings._asked(t, length, digit, parts, request) for t in by("block", text + some)]
    single = [substrings._windows(t, length, answer) for t in by("part", asked)]
    out = arrow("id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    kept = [r for t in by("block", text + [t.filter(pa.compute.equal(t["kind"], 0)) for t in dealt] + single) for r in substrings._cut(t, length, out).to_pylist()]
    assert sorted((r["id"], r["n_bytes"], sha(r["kept"]), [(s["start"], s["end"]) for s in r["spans"]]) for r in kept) == brute_repeats([(i, t or "") for i, t in data], length)
    substrings._powers.cache_clear()


@pytest.mark.parametrize("block", [16 << 20, 200, 1])
def test_lines_across_seams(spark, monkeypatch, block):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    monkeypatch.setattr(blocks, "BLOCK_BYTES", block)
    pa, arrow = lines.pa, lambda ddl: to_arrow_schema(StructType.fromDDL(ddl))
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(12)]
    data = [(i, "\n".join([changed(rng, rng.choice(base), 3) for _ in range(rng.randint(0, 4))] + ["ab", f"Title {i % 7}"])) for i in range(40)]
    body, signed, answer, line = (arrow(x) for x in ("block bigint, ids array<bigint>, data binary", "block bigint, part int, kind int, data binary", "block bigint, part int, kind int, data binary, keys binary", "block bigint, part int, data binary, text binary"))
    whole = [*blocks.texts(iter([pa.RecordBatch.from_pydict({"id": [i for i, _ in data], "text": [t for _, t in data]})]), body)]
    met = [lines._met(t, answer) for t in by("part", [pa.Table.from_batches([b]) for b in lines._signed(iter(whole), 2, 15, 3, signed)])]
    text = [pa.Table.from_batches([b]).append_column("part", pa.array([-1], pa.int32())).append_column("kind", pa.array([-1], pa.int32())) for b in whole]
    near = [lines._verified(t, 2, answer) for t in by("part", [lines._told(t, line) for t in by("block", text + met)])]
    out = arrow("id bigint, n_lines bigint, n_removed bigint, text string")
    gone = [t.filter(pa.compute.equal(t["kind"], 0)) for t in met] + near
    want, exact, before = [], set(), []
    for k, t in data:
        kept = []
        for x in t.split("\n"):
            if x not in exact and not (len(x) >= 15 and any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in before)):
                kept.append(x)
            exact.add(x)
            before += [x] if len(x) >= 15 else []
        want.append((k, "\n".join(kept)))
    assert sorted((r["id"], r["text"]) for t in by("block", text + gone) for r in lines._kept(t, out).to_pylist()) == want


@pytest.mark.parametrize(("block", "long", "sent"), [(16 << 20, 1 << 20, 2 << 20), (300, 7, 50), (1, 1, 1)])
def test_bpe_across_seams(spark, monkeypatch, block, long, sent):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    for module, name, value in ((blocks, "BLOCK_BYTES", block), (bpe, "_LONG", long), (bpe, "_SENT", sent), (bpe, "_REMEMBERED", 5)):
        monkeypatch.setattr(module, name, value)
    pa, path = bpe.pa, public_tokenizers.path(queries.BYTE_BPE)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(path), special_tokens={})
    data = [(i, t) for i, t in enumerate(texts()) if t is None or len(t) < 3000]
    schema = to_arrow_schema(StructType.fromDDL(blocks.schema("bigint")))
    source = pa.RecordBatch.from_pydict({"id": [i for i, _ in data], "text": pa.array([t for _, t in data], pa.string()), "flag": [False] * len(data)})
    built = [pa.Table.from_batches([b]) for b in bpe._built(iter([source]), bpe.partial(bpe._words, public_tokenizers.PATTERN), 3, schema)]
    words = [pa.RecordBatch.from_pydict({k: t[k].combine_chunks() for k in ("block", "part", "data")}) for t in (t.filter(pa.compute.greater_equal(t["part"], 0)) for t in built)]
    coded = [pa.Table.from_batches([b]) for b in bpe._encode_words(iter(words), path, public_tokenizers.PATTERN)]
    documents = [t.filter(pa.compute.less(t["part"], 0)).select(["block", "part", "ids", "sizes", "data"]) for t in built]
    out = to_arrow_schema(StructType.fromDDL("id bigint, n_tokens bigint, ids binary, decoded binary"))
    got = sorted((r["id"], r["ids"], r["decoded"]) for t in by("block", documents + coded) for b in bpe._assemble(iter(t.to_batches()), out, path) for r in b.to_pylist())
    assert got == [(i, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in data]


def test_suffix_order():
    rng = np.random.default_rng(3)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    start = np.arange(len(raw) - 20)
    for length in (5, 8, 13, 20):
        left, group = substrings.repeated_suffixes(raw, start, np.zeros(len(start), np.int64), length)
        want = Counter(raw[i : i + length].tobytes() for i in start)
        assert sorted(left.tolist()) == [i for i in start if want[raw[i : i + length].tobytes()] > 1]
        names = [raw[i : i + length].tobytes() for i in left]
        assert names == sorted(names) and len(set(group.tolist())) == len(set(names))
    with pytest.raises(ValueError):
        substrings.remove_repeats(None, length=4, digit=8)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, line, most):
    b = list(line)
    for _ in range(rng.randint(0, most)):
        i = rng.randrange(len(b) + 1)
        b[i : i + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
    return "".join(b)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(3000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        b, m = changed(rng, a, 4), rng.randint(1, 3)
        assert lines.edit_distance(a, b, m) == min(distance(a, b), m + 1)
        if distance(a, b) <= m and min(len(a), len(b)) > m:
            assert set(lines.signatures(a, m)) & set(lines.signatures(b, m))


def test_lines(spark, docs, empty, odd):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcd ") for _ in range(40)) for _ in range(20)]
    data = [(i, "\n".join([changed(rng, rng.choice(base), 3) for _ in range(rng.randint(0, 4))] + [f"Title {i}"])) for i in range(120)]
    want, before = [], []
    for k, t in data:
        kept = []
        for x in t.split("\n"):
            if len(x) < 20 or not any(abs(len(x) - len(y)) <= 2 and distance(x, y) <= 2 for y in before):
                kept.append(x)
            if len(x) >= 20:
                before.append(x)
        want.append((k, "\n".join(kept)))
    old, lines._LARGE = lines._LARGE, 4
    got = lines.dedup_lines(spark.createDataFrame(data, "doc_id bigint, text string").repartition(4))
    assert by_id(got, "doc_id", "text") == want
    lines._LARGE = old
    kept = lines.dedup_lines(docs, keep=("lang", "source"))
    assert kept.count() == docs.count() and kept.columns[-2:] == ["lang", "source"]
    assert lines.dedup_lines(empty).count() == 0 and lines.dedup_lines(odd).where("text = ''").count() == 2


def test_short_lines_go_as_exact_repeats(spark):
    data = [(1, "ab\n\nab\nTitle 1\n日本"), (2, "Title 2\n \nab\n \n日本\nx"), (3, None), (4, "X\nx\nTitle 1\nTitle 1.\n\n"), (5, "Fifteen points.\nFifteen, point."), (None, "x\nnew")]
    got = lines.dedup_lines(spark.createDataFrame(data, "doc_id bigint, text string").repartition(3))
    assert by_id(got, "doc_id", "n_removed", "text") == [(1, 1, "ab\n\nTitle 1\n日本"), (2, 2, "Title 2\n \n \nx"), (3, 0, ""), (4, 2, "X\nTitle 1.\n\n"), (5, 1, "Fifteen points."), (None, 1, "new")]


@pytest.mark.parametrize(("large", "pairs"), [(48, 1 << 22), (4, 1 << 22), (4, 30), (2, 1)])
def test_large_line_groups(monkeypatch, large, pairs):
    """Variants with places that differ in the middle, at both ends, short ones; small and large groups."""
    monkeypatch.setattr(lines, "_LARGE", large)
    monkeypatch.setattr(lines, "_PAIRS", pairs)
    rng = random.Random(5)
    some = lambda n, letters="ab": "".join(rng.choice(letters) for _ in range(n))
    head, mid, tail = some(40, "abcdefgh"), some(20, "abcdefgh"), some(15, "abcdefgh")
    made = [head + some(30) for _ in range(120)] + [some(4, "0123") + mid + some(5, "0123") + tail for _ in range(120)] + [head[:15] + some(rng.randint(0, 4), "01") for _ in range(20)]
    made += [changed(rng, rng.choice(made), 2) for _ in range(60)]
    rng.shuffle(made)
    made = list(dict.fromkeys(made))
    keys = {}
    for i, t in enumerate(made):
        for s in lines.signatures(t, 2):
            keys.setdefault(s, []).append(i)
    got = lines.repeated(made, {k: g for k, g in keys.items() if len(g) > 1}, 2)
    assert got == {j for j in range(len(made)) if any(lines.edit_distance(made[i], made[j], 2) <= 2 for i in range(j))}


@pytest.mark.parametrize("letters", ["0123456789", "abcdefghijklmnopqrstuvwxyz"])
def test_many_variants_of_one_line(letters):
    """50,000 lines with one place that differs, near each other or not: no time that grows with their square."""
    rng = random.Random(5)
    made = list(dict.fromkeys(f"Page {''.join(rng.choice(letters) for _ in range(5 if letters[0] == '0' else 12))} of the printed volume, all rights reserved" for _ in range(50_000)))
    keys = {}
    for i, t in enumerate(made):
        for s in lines.signatures(t, 2):
            keys.setdefault(s, []).append(i)
    began = time.process_time()
    got = lines.repeated(made, {k: g for k, g in keys.items() if len(g) > 1}, 2)
    assert time.process_time() - began < 120
    for j in rng.sample(range(len(made)), 40):
        assert (j in got) == any(lines.edit_distance(made[i], made[j], 2) <= 2 for i in range(j))


def test_scratch_tables_go(spark):
    there = lambda path: os.path.exists(re.sub("^file:/+", "/", path))
    df = spark.range(10)
    with common.scratch(spark) as keep:
        first, second = common.written(df, "scratch"), keep(common.written(df, "scratch"))
        with common.scratch(spark) as inner:
            third = inner(common.written(df, "scratch"))
        places = [x.written_to for x in (first, second, third)]
        assert all(map(there, places))
    assert [*map(there, places)] == [False, True, False]


def test_scratch_scopes_are_a_threads_own(spark):
    """An operator in another thread doesn't lose its tables when this one's scope ends."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as pool:
        with common.scratch(spark):
            other = pool.submit(lambda: common.written(spark.range(5), "other")).result()
            own = common.written(spark.range(5), "own")
        assert other.count() == 5 and not os.path.exists(re.sub("^file:/+", "/", own.written_to))


def test_bpe(docs, empty, odd):
    path = public_tokenizers.path(queries.BYTE_BPE)
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(path), special_tokens={})
    want = sorted((k, np.array(enc.encode_ordinary(t), "<u4").tobytes(), t.encode()) for k, t in ordered())
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(coded, path).collect()) == want
    fused = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True).collect()
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in fused) == want
    assert bpe.encode(empty, path, public_tokenizers.PATTERN).count() == 0
    assert bpe.encode(odd, path, public_tokenizers.PATTERN).where("n_tokens = 0").count() == 2
