"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_bucket, partitions, text_of

#: Longest piece of a paragraph in code points.
PIECE_CHARS = 48
#: A paragraph ends a section if its last piece's hash ends in a digit of these, besides at blank lines.
SECTION_DIGITS = "08"


def _digest(x: Column, digits: int) -> Column:
    return F.right(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lit(digits))


def leaves(text: Column, piece_chars: int = PIECE_CHARS) -> Column:
    """The leaves of a text in one string: each 12 hex digits of a piece's hash and a mark.

    A piece ends at a sentence's end, a line's end or after ``piece_chars`` code points. Marks: ``.``
    inside a paragraph, ``,`` the last piece of a paragraph (a line), ``;`` the last of a section too.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[^.!?\n]{1,%d}[.!?]*\n*|[.!?]+\n*|\n+" % piece_chars), F.lit(0))

    def leaf(s: Column) -> Column:
        h = _digest(s, 12)
        section = s.endswith("\n\n") | F.right(h, F.lit(1)).isin(*SECTION_DIGITS)
        return F.concat(h, F.when(~s.endswith("\n"), F.lit(".")).when(section, F.lit(";")).otherwise(F.lit(",")))

    return F.array_join(F.transform(pieces, leaf), "")


def _pieces(branch: Column, ends: str) -> Column:
    """Parts of a branch, each up to and with one of the marks ``ends``; an empty branch has none."""
    return F.filter(F.split(branch, f"(?<=[{ends}])"), lambda x: x != "")


def fingerprint(leaf_string: Column) -> Column:
    """``root:sections``, the whole tree in one string.

    A section is ``S`` and 16 hex digits, followed by its paragraphs; a paragraph is ``P`` and 16 hex
    digits, followed by its leaves. A paragraph's hash is that of its leaves as they stand here, a
    section's that of its paragraphs' hashes, the root's that of the sections' hashes, so every node
    follows from what lies below it in the string. Equal roots mean equal texts, but for collisions.
    """

    def paragraph(p: Column) -> Column:
        return F.concat(F.lit("P"), _digest(p, 16), p)

    def section(s: Column) -> Column:
        below = F.transform(_pieces(s, ",;"), paragraph)
        own = F.array_join(F.transform(below, lambda p: F.substring(p, 2, 16)), "")
        return F.concat(F.lit("S"), _digest(own, 16), F.array_join(below, ""))

    sections = F.transform(_pieces(leaf_string, ";"), section)
    top = _digest(F.array_join(F.transform(sections, lambda s: F.substring(s, 2, 16)), ""), 16)
    return F.concat(top, F.lit(":"), F.array_join(sections, ""))


def sections(fp: Column) -> Column:
    """The sections of a fingerprint, each with all that lies below it."""
    return _tail(fp, "S")


def _tail(branch: Column, name: str) -> Column:
    return F.slice(F.split(branch, name), F.lit(2), F.size(F.split(branch, name)))


def _leaves(paragraphs: Column) -> Column:
    """Distinct leaves of paragraphs, without their marks."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: F.filter(F.split(F.substring(p, 17, 1 << 30), "[.,;]"), lambda x: x != ""))))


def _below(sections_: Column) -> Column:
    return F.flatten(F.transform(sections_, lambda s: _tail(s, "P")))


def likeness(a: Column, b: Column) -> Column:
    """How much of two fingerprints is alike, 0 to 1, going down from the roots.

    Equal roots: 1. Else sections that both have are alike with all below them; of the others, so are
    paragraphs that both have; of the paragraphs left, leaves that both have. The likeness is 1 less the
    distinct leaves left over, of both sides, as a share of all distinct leaves of both.
    """
    sa, sb = sections(a), sections(b)
    pa, pb = _below(F.array_except(sa, sb)), _below(F.array_except(sb, sa))
    la, lb = _leaves(F.array_except(pa, pb)), _leaves(F.array_except(pb, pa))
    left = F.size(F.array_except(la, lb)) + F.size(F.array_except(lb, la))
    total = F.size(_leaves(_below(sa))) + F.size(_leaves(_below(sb)))
    return F.when(F.substring(a, 1, 16) == F.substring(b, 1, 16), F.lit(1.0)).otherwise(1.0 - left / total)


def differing(a: Column, b: Column) -> Column:
    """Where ``a`` was edited: positions (from 0) of its sections that ``b`` lacks, and of each the positions of
    the paragraphs that none of ``b``'s other sections have: array of (section, paragraphs)."""
    other = sections(b)
    lost = _below(F.array_except(other, sections(a)))
    at = F.transform(sections(a), lambda s, i: F.struct(i.alias("section"), s.alias("s")))
    gone = F.filter(at, lambda x: ~F.array_contains(other, x["s"]))
    places = lambda s: F.filter(F.transform(_tail(s, "P"), lambda p, i: F.when(~F.array_contains(lost, p), i)), lambda i: i.isNotNull())
    return F.transform(gone, lambda x: F.struct(x["section"].alias("section"), places(x["s"]).alias("paragraphs")))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Fingerprints each whole text and its edited text.

    Edited: the last floor(n/2) code points give way to the first as many of the next document in
    descending ``id_col`` (the first follows the last; a sole document follows itself). Returns
    id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The
    likenesses are taken from the fingerprints returned.

    Null texts count as empty; null ids come last in that order; rows of one id, or of none, follow each
    other by the text's hash, and rows that are equal in both are interchangeable. An empty table gives
    an empty result; other columns of ``docs`` are not read, whatever their names. Texts are taken whole,
    whatever their length.

    The order is made without a global sort: rows are dealt to ranges of id (of id and hash, where one
    id or null has very many rows) of about equal row counts, each range is one window, and the first row
    of each range is sent to the range before it as well. The text moves through one shuffle.
    """
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).withColumn("__tie", F.xxhash64("__text"))
    bucket, ranges = id_bucket(d, "__id", partitions(docs), F.col("__tie"))
    d = d.withColumn("__bucket", bucket)
    # One row per range: bounded by the number of ranges, whatever the number of documents.
    tops = {r["__bucket"]: r["top"] for r in d.groupBy("__bucket").agg(F.max(F.struct("__id", "__tie")).alias("top")).collect()}
    order = sorted(tops, reverse=True)
    tails = [(b, *tops[b], order[i - 1]) for i, b in enumerate(order)]  # the first range's top goes to the last range
    tails_df = spark.createDataFrame(tails, f"__from int, __top {d.schema['__id'].dataType.simpleString()}, __hash bigint, __to int")
    match = (F.col("__bucket") == F.col("__from")) & F.col("__id").eqNullSafe(F.col("__top")) & (F.col("__tie") == F.col("__hash"))
    extra = d.join(F.broadcast(tails_df), match).groupBy("__to").agg(F.first("__id").alias("__id"), F.first("__text").alias("__text"), F.first("__tie").alias("__tie"))
    extra = extra.select("__id", "__text", "__tie", F.col("__to").alias("__bucket"), F.lit(True).alias("__tail"))
    chained = d.withColumn("__tail", F.lit(False)).unionByName(extra).repartitionById(max(1, ranges), F.col("__bucket"))
    chained = chained.withColumn("__fp", fingerprint(leaves(F.col("__text"), piece_chars)))
    w = Window.partitionBy("__bucket").orderBy("__tail", F.col("__id").desc_nulls_last(), F.col("__tie").desc())
    chained = chained.select("*", F.lead("__text").over(w).alias("__next"), F.lead("__fp").over(w).alias("__next_fp")).where("not __tail")
    size = F.length("__text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.left(F.col("__text"), size - half), F.left(F.col("__next"), half))
    out = chained.select("__id", "__fp", "__next_fp", size.cast("bigint").alias("n_chars"), edited.alias("__edited"))
    out = out.withColumn("__edited_fp", fingerprint(leaves(F.col("__edited"), piece_chars)))
    return out.select(
        F.col("__id").alias(id_col),
        "n_chars",
        F.sha2(F.col("__edited").cast("binary"), 256).alias("edited_sha256"),
        F.col("__fp").alias("fingerprint"),
        F.col("__edited_fp").alias("edited_fingerprint"),
        likeness(F.col("__fp"), F.col("__edited_fp")).alias("near_edited"),
        likeness(F.col("__fp"), F.col("__next_fp")).alias("near_next"),
    )
