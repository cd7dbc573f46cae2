"""The operators over the tables of a data folder, with production parameters: op1 to op13."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, brown, fingerprints, forest, infill, lines, mixing, neighbours, quality, simhash, substrings, token_store, tries

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_multi_50k.tiktoken"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, str(f.relative_to(top.parent)))
    path = os.path.join(tempfile.mkdtemp(), f"{top.name}.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)  # the driver serves it to every executor
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    tokens = token_store.load(*token_store.save(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_brown_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source", "row_hash", "row_check")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path = public_tokenizers.path(BYTE_BPE)
    tokens = bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decoded=True)
    return tokens.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return tries.prefix_trie(tries.rebuilt(tries.sequences(table(spark, sf_dir, "conversations"))))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2(F.col("output").cast("binary"), 256), F.sha2(infill.restored(F.col("output"), F.col("form")).cast("binary"), 256)
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digests[0].alias("output_sha256"), digests[1].alias("restored_sha256"))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return forest.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_document_fingerprints, op2_quality_classifier, op3_nearest_neighbours, op4_token_binary, op5_brown_scoring,
        op6_simhash_near_dedup, op7_mix_sources, op8_suffix_dedup, op9_line_dedup, op10_byte_bpe, op11_conversation_trie, op12_fill_in_middle,
        op13_minhash_near_dedup,
    )
    return {f.__name__: f for f in every}


#: Windows of 100 bytes as hex digits, each but the first of equal ones removing its bytes.
_SUFFIX_SQL = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, h, length(h) // 2 AS n, unnest(range((length(h) // 2 + 499) // 500)) * 500 AS base FROM d),
q AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, 1198) AS s FROM c),
p AS (SELECT doc_id, n, base, s, unnest(range(least(500, n - base))) AS o FROM q),
w AS (SELECT doc_id, base + o AS i, substr(s, 2 * o + 1, 2) AS b, CASE WHEN base + o + 100 <= n THEN md5(substr(s, 2 * o + 1, 200)) END AS k FROM p),
r AS (SELECT doc_id, i, b, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, b, max(CASE WHEN again THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM g),
s AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN s ON s.doc_id = d.doc_id"""


#: CRC-32 of a string of ASCII characters, bit by bit; numbers are 64 bits wide.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(range(length({0})), lambda i: CAST(ord(substr({0}, i + 1, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: A turn is the text "role length:role text"; a node is the list of its turns.
_TRIE_SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(length(role) || ':' || role || text ORDER BY turn NULLS FIRST, role, text) AS turns,
  list(strlen(text) ORDER BY turn NULLS FIRST, role, text) AS bytes FROM t GROUP BY conv_id),
h AS (SELECT *, CAST(conv_id AS VARCHAR) AS k FROM o),
c AS (SELECT *, {_CRC32.format("k")} % 9 AS h FROM h),
r AS (SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns, list_concat(coalesce(b.bytes, [])[1:c.h], c.bytes[c.h + 1:]) AS bytes
  FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, turns, bytes, unnest(range(len(turns) + 1)) AS d FROM r),
m AS (SELECT turns[1:d] AS node, d, conv_id, len(turns) = d AS ends, CASE WHEN d > 0 THEN bytes[d] ELSE 0 END AS b FROM p),
n AS (SELECT node, any_value(d) AS d, min(conv_id) AS conv_id, count(*) AS n, any_value(b) AS b,
  sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM m GROUP BY node),
k AS (SELECT node[1:d - 1] AS node, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
e AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN k ON k.node = n.node),
u AS (SELECT node, (n - 1) * b AS saved, children = 0 AS leaf, unnest(range(d + 1)) AS up FROM e),
s AS (SELECT node[1:up] AS node, sum(saved) AS saved, count(*) FILTER (WHERE leaf) AS leaves FROM u GROUP BY 1)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, CAST(e.n AS BIGINT) AS n_convs, CAST(e.children AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s ON s.node = e.node LEFT JOIN n q ON e.d > 0 AND q.node = e.node[1:e.d - 1]"""

_INFILL_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
  [CAST('0x' || substr(s, 8 * i + 1, 8) AS UBIGINT) FOR i IN range(4)] AS h FROM d),
n AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
c AS (SELECT *, CAST(least(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS lo, CAST(greatest(h[1] % (n + 1), h[2] % (n + 1)) AS BIGINT) AS hi FROM n),
x AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:], '') AS q FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM x"""


#: Pairs of distinct sets that share a shingle, by size of intersection and union; then the smallest id reachable.
_NEAR_SQL = r"""WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
d AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])) END AS s FROM t),
k AS (SELECT min(r) AS c, s, len(s) AS n FROM d GROUP BY s),
h AS (SELECT c, n, unnest(s) AS x FROM k),
p AS (SELECT a.c AS a, b.c AS b FROM h a JOIN h b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT c, c FROM k),
g AS (SELECT a, b FROM e UNION SELECT g.a, e.b FROM g JOIN e ON e.a = g.b),
m AS (SELECT k.s, d.doc_id FROM d JOIN k ON k.s = d.s),
o AS (SELECT k.s, min(m.doc_id) AS id FROM k JOIN g ON g.a = k.c JOIN k q ON q.c = g.b JOIN m ON m.s = q.s GROUP BY k.s)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE o.id END AS component_id, len(d.s) = 0 OR d.doc_id = o.id AS kept FROM d JOIN o ON o.s = d.s"""


def oracle_sql() -> dict[str, str]:
    """The other operators' digests need hashes, tokenizers, models or orders that SQL hasn't: tests hold
    them against brute force."""
    return {"op8_suffix_dedup": _SUFFIX_SQL, "op11_conversation_trie": _TRIE_SQL, "op12_fill_in_middle": _INFILL_SQL, "op13_minhash_near_dedup": _NEAR_SQL}
