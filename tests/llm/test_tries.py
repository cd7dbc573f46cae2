"""The prefix trie of conversations against brute force, and its merge by itself."""

import hashlib
import random
import zlib

import pytest

from factorloom.llm import queries, tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digests string, n bigint, part int, hash string"


def talks():
    """Shared openings, copies, null and repeated turns, long and short conversations."""
    rng = random.Random(7)
    lines = ["hello", "é 日本", None, "", "a b", "yes,", "no"]
    out = []
    for c in range(90):
        if c % 11 == 3:
            continue
        opening = rng.choice([[0, 1, 2], [0, 1], [0, 4, 4, 4], [5]])
        said = [lines[i] for i in opening] + [rng.choice(lines) for _ in range(rng.choice([0, 0, 1, 3]))]
        out += [(c, None if i == 0 and c % 2 else i, ["user", "bot", None][i % 3], t) for i, t in enumerate(said)]
    out += [(200 + 5 * i, t, "user", f"line {t}") for i in range(40) for t in range(3)]  # copies
    out += [(1001, t, "user", f"long {t}") for t in range(300)]
    out += [(7, 1, "user", "again"), (7, 1, "bot", "again"), (None, 1, "user", "x"), (-12, 0, "user", "hello"), (None, None, None, None)]
    rng.shuffle(out)
    return out


def brute_sequences(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: tuple((r, t) for _, _, r, t in sorted(v)) for c, v in own.items()}


def brute_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, ())[:h] + turns[h:]
    return out


def brute_trie(seqs):
    members, ends = {}, {}
    for c, s in seqs.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children.get(p, [])), leaves[p], saved[p], sha(p)) for p, m in members.items())


def rows_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if r[c] is None else r[c] for c in names) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


@pytest.mark.parametrize("options", [{}, {"run_turns": 40, "block_turns": 7, "waiting": 3, "piece": 5}])
@pytest.mark.parametrize("parts", [1, 9])
def test_trie(spark, options, parts):
    queries.ship(spark)
    rows, before = talks(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        seqs = tries.sequences(table(spark, rows).repartition(3))
        got = rows_of(tries.prefix_trie(tries.rebuilt(seqs), **options))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_trie(brute_rebuilt(brute_sequences(rows)))


def test_trie_of_sequences_as_they_are(spark):
    rows = talks()
    assert rows_of(tries.prefix_trie(tries.sequences(table(spark, rows)))) == brute_trie(brute_sequences(rows))


def test_trie_of_none_and_of_turnless(spark):
    assert tries.prefix_trie(tries.sequences(table(spark, []))).collect() == []
    assert tries.prefix_trie(tries.sequences(table(spark, [(None, 1, "a", "b")]))).collect() == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    got = rows_of(tries.prefix_trie(tries.rebuilt(tries.sequences(table(spark, [(c, 0, "user", "hi")])))))
    assert got == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


@pytest.mark.parametrize(("runs", "block"), [(1, 1), (3, 2), (8, 5), (5, 100)])
def test_merge_of_runs(runs, block):
    rng = random.Random(runs)
    every = [([rng.choice([b"a" * 16, b"b" * 16]) for _ in range(rng.randrange(6))], i, []) for i in range(200)]
    every = [(d, i, list(range(len(d)))) for d, i, _ in every]
    blocks = []
    for r in range(runs):
        run = tries.sorted_run(every[r::runs])
        for at in range(0, len(run), block):
            some = run[at : at + block]
            blocks.append((r, some[0][1], some[0][2], tries.pack_block(some)))
    got, before = [], []
    for lcp, digests, conv, sizes in tries.merged(sorted(blocks, key=lambda b: b[1:3])):
        assert lcp == tries.shared(before, digests)
        got.append((digests, conv, sizes))
        before = digests
    assert got == sorted(every)


def test_a_loser_tree_compares_no_shared_turn_again(monkeypatch):
    """Four runs of sequences that share 50 turns: beyond the first comparisons only later turns are looked at."""
    runs = [tries.sorted_run([([b"x" * 16] * 50 + [i.to_bytes(16, "big")], i, [1] * 51) for i in range(r, 400, 4)]) for r in range(4)]
    looked = []
    shared = tries.shared
    monkeypatch.setattr(tries, "shared", lambda a, b, known=0: looked.append((n := shared(a, b, known)) - known) or n)
    blocks = sorted(((r, e[0][1], e[0][2], tries.pack_block(e)) for r, e in enumerate(runs)), key=lambda b: b[1:3])
    assert [e[2] for e in tries.merged(blocks)] == list(range(400))
    assert sum(looked) < 50 * 40


def test_query(spark):
    from factorloom.llm.queries import op11_conversation_trie

    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_conversation_trie(spark, data)) == brute_trie(brute_rebuilt(brute_sequences(rows)))
