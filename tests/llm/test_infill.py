"""Fill-in-middle against a regular expression, and outputs undone."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from factorloom.llm import infill, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, n bigint, form string, output string, id string, prefix_chars bigint"


def texts():
    rng = random.Random(3)
    pieces = [" ", "\n", "\t", "\x0b", "\x1c", " ", "a", "bc", "é", "日本", "😀", "<", "P>", "<S", ">", "."]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(300)]
    return [None, "", " ", " \n", "one", " one", "one ", "x <P> y", "<S>", "z<M>", "<P", "the same text here", "the same text here", "word " * 40_000, "w" * 300_000, "\n" * 100_000, *made]


def brute(doc_id, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    lo, hi = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_units_by_gaps():
    a = infill.scanner()
    for t in texts():
        t = t or ""
        spaces, marked = infill.scan(a, t)
        assert infill.unit_ends(spaces, len(t)).tolist() == [m.end() for m in UNIT.finditer(t)]
        assert marked == bool(re.search("<[PSM]>", t))


def test_fill_in_middle(spark):
    queries.ship(spark)
    rows = [(i, t, 7, "x", "y", "z", 1) for i, t in enumerate(texts())]
    rows += [rows[11], rows[11], (None, "a null id in a text", *[None] * 5), (None, None, *[None] * 5)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for rate, spm in ((50, 80), (100, 0), (100, 100), (0, 50)):
        out = infill.fill_in_middle(d, rate=rate, spm_rate=spm).withColumn("again", infill.restored(F.col("output"), F.col("form")))
        got = sorted(tuple(r) for r in out.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("prefix_chars", "middle_chars")}).collect())
        want = sorted((-1 if r[0] is None else r[0], *(-1 if x is None else x for x in brute(r[0], r[1], rate, spm)), r[1] or "") for r in rows)
        assert got == want
        assert rate != 50 or {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_none(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_batches(monkeypatch, spark):
    monkeypatch.setattr(infill, "_BATCH_CHARS", 100)
    import pyarrow as pa

    ts = texts()
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ts)), pa.int64()), pa.array(ts, pa.string())], ["id", "text"])
    out = [tuple(r.values()) for b in infill._transformed(iter([batch]), schema) for r in b.to_pylist()]
    assert out == [(i, *brute(i, t)) for i, t in enumerate(ts)]
