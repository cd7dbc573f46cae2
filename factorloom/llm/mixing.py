"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions, written

#: Words to a block of the schedule, at most; and slots that a smaller mix has by smaller blocks.
BLOCK_WORDS, LEAST_SLOTS = 256, 1 << 14
#: Most times that a source's words are used.
MOST_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space, tab, line feed, vertical tab, form feed, return."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> dict:
    """Target words per source. Sources in code-point order, null last, weigh ``weights``, repeating,
    and share all words; targets stop at ``most`` times the source's size, what is above is shared
    anew by weight among the others until none is above."""
    order = sorted(sizes, key=lambda x: (x[0] is None, [*map(ord, x[0] or "")]))
    size = {s: n for s, n in order}
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    out = dict.fromkeys(size, 0.0)
    left, open_ = float(sum(size.values())), set(size)
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in size if s in open_ and left * weight[s] / total > most * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = float(most * size[s])
            open_.discard(s)
        left -= sum(out[s] for s in full)
    return out


def block_size(total: int, most: int = BLOCK_WORDS) -> int:
    """Words to a block: small enough that a mix has LEAST_SLOTS slots, so that the few slots by which a source's
    number strays from its share are few words of its target."""
    return max(1, min(most, total // LEAST_SLOTS))


def source_plan(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), block_words: int = BLOCK_WORDS, most: int = MOST_EPOCHS) -> list[tuple]:
    """A row for each source: number, source, size, target, blocks, from, to, whole, part.

    A source's line of words is cut into ``blocks`` equal blocks (of about ``block_words``, sizes differ by
    one word at most; a shorter line is one block). ``from`` and ``to`` bound its interval of [0, 1):
    sources have intervals in proportion to the blocks that their targets take. The target is ``whole``
    blocks, beginning again after the last, and ``part`` words of one more.
    """
    goal = targets(sizes, weights, most)
    rows, at = [], 0.0
    for i, (s, n) in enumerate(sorted(sizes, key=lambda x: (x[0] is None, [*map(ord, x[0] or "")]))):
        blocks = max(1, round(n / block_words)) if n else 0
        words = min(round(goal[s]), most * n)
        epochs, rest = divmod(words, n) if n else (0, 0)
        base, extra = divmod(n, blocks) if blocks else (0, 0)
        inside = rest // (base + 1) if rest < extra * (base + 1) else extra + (rest - extra * (base + 1)) // max(base, 1) if rest else 0
        share = goal[s] * blocks / n if n else 0.0
        rows.append((i, s, n, goal[s], blocks, at, at + share, epochs * blocks + inside, rest - inside * base - min(inside, extra)))
        at += share
    return [(*r[:5], r[5] / at if at else 0.0, r[6] / at if at else 0.0, *r[7:]) for r in rows]


def settled(got: Column, whole: Column, part: Column, most: Column) -> tuple[Column, Column]:
    """Whole blocks, and words of one more, that a source with ``got`` slots takes: the last block alone is settled.

    A source that is short takes one block, or the part that it lacks, after the last slot; one that has more gives
    up its last block, or what is beyond the target of it. What then is left is the schedule's. ``most``: all blocks of
    all epochs.
    """
    blocks = F.when(got < whole, got + 1).when(got <= whole + 1, whole).otherwise(got - 1)
    words = F.when((got == whole) | (got == whole + 1), part).otherwise(F.lit(0))
    return F.least(blocks, most), F.when(blocks < most, words).otherwise(F.lit(0))


def schedule(plan: DataFrame, slots: int, n: int) -> DataFrame:
    """The mix, slot by slot: id (from 1) and the source __s in whose interval the slot's van der Corput point falls.

    Points and intervals meet by equality of a cell of [0, 1), several to a source, then by comparison.
    """
    cells = min(1 << 22, max(256, 4 * plan.count()))
    cell = lambda x: F.floor(F.col(x) * F.lit(float(cells))).cast("int")
    spans = plan.where("__to > __from").select("__s", "__from", "__to", F.explode(F.sequence(cell("__from"), F.least(cell("__to"), F.lit(cells - 1)))).alias("__cell"))
    points = plan.sparkSession.range(1, slots + 1, 1, n).withColumn("__u", van_der_corput(F.col("id"))).withColumn("__cell", cell("__u"))
    return points.join(spans, "__cell").where("__u >= __from and __u < __to").select("id", "__s")


def _starts(block: Column, size: Column, blocks: Column) -> Column:
    """First word of a block of a line of ``size`` words in ``blocks`` equal blocks, the longer ones first."""
    base = F.floor(size / blocks)
    return block * base + F.least(block, size - base * blocks)


def _block_of(word: Column, size: Column, blocks: Column) -> Column:
    base = F.expr("source_size div __blocks")
    head = (size - base * blocks) * (base + 1)
    return F.when(word < head, F.floor(word / (base + 1))).otherwise(size - base * blocks + F.floor((word - head) / base))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), block_words: int | None = None, most: int = MOST_EPOCHS, alike: tuple[str, ...] = ()) -> DataFrame:
    """How many words of each document the mix takes, and when: id_col, source, size, source_size,
    target, taken, first_slot (null if none are taken), slots (that take some), row_hash, row_check (two hashes of
    id, source, text and the columns ``alike``).

    Each source's documents are put in a hashed order, and their line of words is cut into equal blocks
    (source_plan; of block_size() words if ``block_words`` isn't given). Slot t of the mix belongs to the source
    in whose interval the t-th van der Corput point falls; the r-th slot of a source takes its r-th block, and
    begins again after the last. What a source gets is what its slots hold, but for the last block (settled()): the
    points of any first n slots fall in an interval to within log2(n) + 1 slots of its share, so sources come
    as near to their targets, and the mix is even from its first slot to its last.

    Null text: no words. Null source: a source of its own. Repeated rows, and rows without id, count each
    for itself; among equal rows it isn't said which has the words. Texts count whole, whatever their
    length. An empty table gives an empty result; other columns are not read, whatever their names.

    The order within a source is a prefix sum in two levels (hash ranges, then rows), and slots are
    ranked in two levels too, so a source with most rows fills no single task. Only figures per source
    come to the driver.
    """
    placed, taken = _dealt(docs, id_col, text_col, source_col, weights, block_words, most, alike)
    sums = taken.groupBy("__row").agg(F.sum("__words").alias("taken"), F.min("__slot").alias("first_slot"), F.sum("__slots").alias("slots"))
    out = placed.join(sums, "__row", "left")
    return out.select(F.col("__id").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), "first_slot", F.coalesce("slots", F.lit(0)).cast("bigint").alias("slots"), F.col("__h").alias("row_hash"), F.col("__c").alias("row_check"))


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[float, ...], block_words: int | None, most: int, alike: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Documents by __row in their source's line, and what is taken of them: (__row, __epoch, __words, __slot, __slots)."""
    spark = docs.sparkSession
    n = partitions(docs)
    same = [F.col(id_col), F.col(source_col), F.col(text_col), *(F.col(c) for c in alike)]
    d = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(17), *same).alias("__h"), F.xxhash64(F.lit(18), *same).alias("__c"))
    d = written(d.withColumn("__range", F.least(F.floor((F.col("__h").cast("double") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("int")), "mix-sizes")
    by_source = [(r["source"], r["n"]) for r in d.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    planned = source_plan(by_source, weights, block_words or block_size(sum(k for _, k in by_source)), most)
    plan = spark.createDataFrame(planned, "__s int, source string, source_size bigint, target double, __blocks bigint, __from double, __to double, __whole bigint, __part bigint")
    plan = written(plan, "mix-plan")
    slots = sum(r[7] for r in planned)

    # Each document's first word in its source's order.
    d = d.join(plan, d["source"].eqNullSafe(plan["source"])).select(d["*"], "__s", "source_size", "__blocks", "target")
    ranges = d.groupBy("__s", "__range").agg(F.sum("size").alias("__n"))
    ranges = ranges.select("__s", "__range", (F.sum("__n").over(Window.partitionBy("__s").orderBy("__range")) - F.col("__n")).alias("__base"))
    w = Window.partitionBy("__s", "__range").orderBy("__h", "__c", F.col("__id").asc_nulls_last(), "size")
    placed = d.withColumn("__in", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.join(ranges, ["__s", "__range"]).withColumn("__start", F.col("__base") + F.col("__in"))
    placed = written(placed.drop("__range", "__base", "__in").withColumn("__row", F.monotonically_increasing_id()), "mix-placed")

    # The schedule: slot -> source -> rank -> block; then what each source takes of its slots.
    dealt = schedule(plan, slots, n).withColumn("__chunk", F.floor((F.col("id") - 1) / max(1, -(-slots // n))).cast("int"))
    counts = dealt.groupBy("__s", "__chunk").agg(F.count("*").alias("__n"))
    counts = written(counts.select("__s", "__chunk", "__n", (F.sum("__n").over(Window.partitionBy("__s").orderBy("__chunk")) - F.col("__n")).alias("__base")), "mix-counts")
    rank = F.row_number().over(Window.partitionBy("__s", "__chunk").orderBy("id"))
    ranked = dealt.withColumn("__r", rank).join(counts.drop("__n"), ["__s", "__chunk"]).select("__s", (F.col("__base") + F.col("__r") - 1).alias("__r"), F.col("id").alias("__slot"))
    shares = plan.join(counts.groupBy("__s").agg(F.sum("__n").alias("__dealt")), "__s", "left").withColumn("__dealt", F.coalesce("__dealt", F.lit(0)))
    full, rest = settled(F.col("__dealt"), F.col("__whole"), F.col("__part"), F.col("__blocks") * most)
    shares = written(shares.select("__s", "__blocks", "__dealt", full.alias("__full"), rest.cast("bigint").alias("__rest")), "mix-shares")
    short = F.col("__full") + F.when(F.col("__rest") > 0, 1).otherwise(0) > F.col("__dealt")
    added = shares.where(short).select("__s", F.col("__dealt").alias("__r"), (F.lit(slots + 1) + F.col("__s")).cast("bigint").alias("__slot"))
    uses = ranked.unionByName(added).join(shares, "__s").where("__r < __full or (__r = __full and __rest > 0)")
    uses = uses.select("__s", (F.col("__r") % F.col("__blocks")).alias("__block"), F.floor(F.col("__r") / F.col("__blocks")).alias("__epoch"), "__slot", F.when(F.col("__r") == F.col("__full"), F.col("__rest")).alias("__cut"))

    # Each document's words by block, joined to the slots of that block; the last block may be taken in part.
    size, blocks = F.col("source_size"), F.col("__blocks")
    first, last = _block_of(F.col("__start"), size, blocks), _block_of(F.col("__start") + F.col("size") - 1, size, blocks)
    parts = placed.where("size > 0").select("__row", "__s", "__start", "size", "source_size", "__blocks", F.explode(F.sequence(first, last)).alias("__block"))
    lo, hi = _starts(F.col("__block"), size, blocks), _starts(F.col("__block") + 1, size, blocks)
    until = F.when(F.col("__cut").isNotNull(), lo + F.col("__cut")).otherwise(hi)
    words = F.greatest(F.least(F.col("__start") + F.col("size"), until) - F.greatest(F.col("__start"), lo), F.lit(0))
    taken = parts.join(uses, ["__s", "__block"]).select("__row", "__epoch", "__slot", words.alias("__words")).where("__words > 0")
    return placed, taken.groupBy("__row", "__epoch").agg(F.sum("__words").alias("__words"), F.min("__slot").alias("__slot"), F.count("*").alias("__slots"))


def van_der_corput(slot: Column) -> Column:
    """The slot's binary digits mirrored at the point: a double in [0, 1), exact to 2**-53."""
    digits = F.bin(slot)
    return F.conv(F.reverse(digits), 2, 10).cast("double") / F.pow(F.lit(2.0), F.length(digits))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def leading_words(text: str, n: int) -> str:
    """The text up to the end of its n-th word."""
    for i, m in enumerate(_WORD.finditer(text), 1):
        if i >= n:
            return text[: m.end()]
    return text


def taken_text(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), block_words: int | None = None, most: int = MOST_EPOCHS) -> DataFrame:
    """The mix as rows in the order of its slots: a row of ``columns`` for each time that a document is taken, at the
    slot that takes its first words; the last time perhaps in part (its leading words).

    Rows alike in all of ``columns`` are as one that is taken as often as they are together, so no word is
    lost. Documents that nothing is taken of go; those without words take none. Null texts and empty
    tables give no rows. Columns not in ``columns`` are not read.
    """
    placed, taken = _dealt(docs, id_col, text_col, source_col, weights, block_words, most, columns)
    uses = taken.join(placed.select("__row", "__h", "__c", "size"), "__row").select("__h", "__c", "__slot", "__words", (F.col("__words") < F.col("size")).alias("__part"))
    keys = ["__h", "__c"]
    same = [F.col(id_col), F.col(source_col), F.col(text_col), *(F.col(c) for c in columns)]
    j = docs.select(*columns, F.xxhash64(F.lit(17), *same).alias("__h"), F.xxhash64(F.lit(18), *same).alias("__c")).dropDuplicates(keys).join(uses, keys)

    @F.pandas_udf("string")
    def cut(text: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([leading_words(t, n) for t, n in zip(text, words, strict=True)])

    whole = j.where("not __part").select(*columns, "__slot", *keys)
    part = j.where("__part").withColumn(text_col, cut(F.col(text_col), "__words")).select(*columns, "__slot", *keys)
    return whole.unionByName(part).orderBy("__slot", *keys).select(*columns)
