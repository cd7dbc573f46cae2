"""The pipeline against brute force, and each of its stages on odd tables."""

import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from factorloom.llm import bpe, common, lines, mixing, queries

from test_operators import WORDS, brute_jaccard, distance, sha

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    data = [(i, " ".join(rng.choice(WORDS) for _ in range(60)) + f" number {i}.", "en", f"s{i % 2}", 0) for i in range(60)]
    data += [(i, " ".join(rng.choice(WORDS) + "$$$" for _ in range(60)), "en", "s0", 0) for i in range(60, 80)]
    data += [(90, data[0][1], "en", "s1", 0)]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int(d[0] < 60)) for d in data if d[0] != 90], "doc_id bigint, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(pipeline.STAGES):
        docs = common.written(stage(spark, docs, str(tmp_path)), f"test-{i}")
        tables.append(docs.collect())
        if i < 4:
            assert docs.columns == list(pipeline.COLUMNS) and all(r.n_chars == len(r.text) for r in tables[-1] if i)
    kept, deduped, distinct = ({r.doc_id: r for r in t} for t in tables[:3])
    mixed, coded = tables[3:]
    assert set(kept) == {d[0] for d in data if not 60 <= d[0] < 80}
    before = []
    for k in sorted(kept):
        want = []
        for x in kept[k].text.split("\n"):
            if len(x) < lines.LEAST_CHARS or not any(distance(x, y) <= lines.MOST_EDITS for y in before if abs(len(x) - len(y)) <= lines.MOST_EDITS):
                want.append(x)
            if len(x) >= lines.LEAST_CHARS:
                before.append(x)
        assert deduped[k].text == "\n".join(want)
    near = brute_jaccard([(k, r.text) for k, r in deduped.items()])
    assert set(distinct) == {near.root(k) for k in deduped}
    sizes = {}
    for r in distinct.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    goal, took = mixing.targets(list(sizes.items())), dict.fromkeys(sizes, 0)
    for r in mixed:
        took[r.source] += len(r.text.split())
        assert distinct[r.doc_id].text.startswith(r.text)
    assert all(abs(took[s] - goal[s]) <= 4 * max(1, mixing.block_size(sum(sizes.values()))) for s in goal)
    words = Counter()
    for r in mixed:
        words[r.doc_id] += len(r.text.split())
    assert all(n <= 3 * len(distinct[k].text.split()) for k, n in words.items())
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(public_tokenizers.path(queries.BYTE_BPE)), special_tokens={})
    want = sorted((r.doc_id, sha(np.array(enc.encode_ordinary(r.text), "<u4").tobytes()), sha(r.text.encode())) for r in mixed)
    assert sorted((r.doc_id, sha(bytes(r.ids)), r.decoded_sha256) for r in coded) == want
    assert pipeline.run(spark, str(tmp_path)).count() == len(coded)


ODD = {
    "empty table": [],
    "one row": [(1, "Some words of one text.", "en", "a", 23)],
    "nulls": [(None, None, None, None, None), (1, None, "en", "a", None), (None, "A text without id, and of no source.", "en", None, 1), (2, "", "en", "a", 0), (3, " \n\t", None, "b", 3)],
    "repeated rows": [(1, "the same words, said again and again", "en", "a", 36)] * 4 + [(2, "the same words, said again and again", "en", "a", 36), (None, "the same words", "en", "a", 14), (None, "the same words", "en", "a", 14)],
    "a long text": [(1, "word " * 60_000 + "end\nline\nline", "en", "a", 1), (2, "x" * 300_000, "en", "b", 1), (3, "short", "en", "b", 5)],
}


@pytest.mark.parametrize("case", ODD)
def test_stages_on_odd_tables(spark, tmp_path, case):
    """Nulls in any column, empty tables and texts, ties, repeated rows, and extra columns of clashing names."""
    queries.ship(spark)
    data = ODD[case]
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(data, SCHEMA)
    for c in ("score", "__stats", "row_hash", "fp", "key", "block", "part", "id", "size", "taken", "__h", "quality"):
        docs = docs.withColumn(c, F.lit("x"))
    quality_, line, near, mix, encode = (f for _, f in pipeline.STAGES)
    kept = quality_(spark, docs, str(tmp_path))
    assert kept.columns == list(pipeline.COLUMNS) and kept.count() == len(data)  # labels of one kind: all stay
    out = line(spark, docs, str(tmp_path))
    assert out.columns == list(pipeline.COLUMNS) and out.count() == len(data)
    out = near(spark, docs, str(tmp_path))
    roots = brute_jaccard([(i, r[1]) for i, r in enumerate(data)])
    assert out.columns == list(pipeline.COLUMNS)
    groups = {}
    for i, r in enumerate(data):
        groups.setdefault(roots.root(i), []).append(r[0])
    least = Counter()
    for ids in groups.values():
        k = min((x for x in ids if x is not None), default=None)
        least[k] += ids.count(k)
    assert Counter(r.doc_id for r in out.collect()) >= least  # rows of a kept id stay together
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    goal, took = mixing.targets(list(sizes.items())), dict.fromkeys(sizes, 0)
    out = mix(spark, docs, str(tmp_path))
    assert out.columns == list(pipeline.COLUMNS)
    for r in out.collect():
        took[r.source] += len(r.text.split())
    assert all(abs(took[s] - goal[s]) <= 4 * max(1, mixing.block_size(sum(sizes.values()))) for s in goal)
    out = encode(spark, docs, str(tmp_path))
    assert sorted(r.decoded_sha256 for r in out.select("decoded_sha256").collect()) == sorted(sha((r[1] or "").encode()) for r in data)
