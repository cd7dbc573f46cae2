"""The training-corpus pipeline: quality, line dedup, near-dedup, mixing, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.llm import bpe, lines, mixing, quality, wide
from factorloom.llm.common import scratch, written
from factorloom.llm.queries import BYTE_BPE, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, learnt from the labels of documents that are here."""
    rules = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, rules).where(F.col("score") >= quality.KEEP_SCORE).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat an earlier one."""
    ship(spark)
    kept = lines.dedup_lines(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


#: Near-duplicates: similarity of sets of five-word shingles.
SIMILARITY = (4, 5)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, component_id: groups of near-duplicates; texts without words are alike."""
    return wide.near_duplicates(docs, similarity=SIMILARITY, alike_empty=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8, found by deletion variants of SimHash segments) the document
    of the smallest id. Rows of one id stay or go together."""
    ship(spark)
    kept = linked(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, in the order of its slots: a row for each time that one is taken, the last time perhaps in part."""
    ship(spark)
    taken = mixing.taken_text(docs, COLUMNS[:-1])
    return taken.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the bytes that they decode to."""
    ship(spark)
    path = public_tokenizers.path(BYTE_BPE)
    tokens = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return tokens.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

#: Rules, edits and tokens are beyond SQL: tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark) as keep:  # the stage's own tables go
            docs = keep(written(stage(spark, docs, sf_dir), f"pipeline-{i}"))
    return STAGES[-1][1](spark, docs, sf_dir)
