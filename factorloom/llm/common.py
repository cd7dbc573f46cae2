"""What the operators share: the shared folder, written tables, columns and union-find."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    It is set here only where it is unset and all tasks run on the driver's machine (tests).
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="factorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    if "://" not in found:  # a path of the default file system, spelled out for readers other than Spark
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(found)
        full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
        found = full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
    return found.rstrip("/")


#: The scopes that are open where code runs: threads have their own.
_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def workspace(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; nothing is made there yet. It goes with the innermost scratch()."""
    path = f"{shared_dir(spark)}/factorloom/{name}-{uuid.uuid4().hex}"
    if scopes := _scopes.get():
        scopes[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within go at its end, but for what written() gave and the function it gives keeps.

    Results are read from such tables, so a caller that wants them gone puts an operator and the writing
    of its result within one scope: ``with scratch(spark): near_duplicates(docs).write.parquet(path)``.
    """
    own: list[str] = []
    scopes = _scopes.get()
    outer = scopes[-1] if scopes else None
    token = _scopes.set((*scopes, own))

    def keep(df: DataFrame) -> DataFrame:
        own.remove(df.written_to)
        if outer is not None:
            outer.append(df.written_to)
        return df

    try:
        yield keep
    finally:
        _scopes.reset(token)
        for path in own:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back, which cuts its lineage.

    Spark's commit protocol keeps one attempt of each task, so what is read is stable however often
    tasks are retried or executors are lost.
    """
    path = workspace(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def partitions(df: DataFrame) -> int:
    """Shuffle partitions that grow with the input: the session's number or that of the input's splits.

    Inputs should be scans or narrow steps over them, as of tables and of what written() gives: shuffles in
    an input's plan would run for its splits to be known.
    """
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def text_of(text_col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def id_bucket(df: DataFrame, id_col: str, n: int, tie: Column) -> tuple[Column, int]:
    """About ``n`` ranges of (``id_col``, ``tie``) of about equal row counts: an int from 0 that grows with
    both, and how many there are. Null ids come first; ``tie`` is a 64-bit hash.

    Two levels, so that the expression stays small: at most 256 quantile ranges found by an approximate
    percentile over all rows, each cut evenly into equal widths. Null, and an id that alone holds several
    quantiles, are cut by ``tie`` into as many ranges as they hold.
    """
    coarse = max(1, min(n, 256))
    fine = -(-max(n, 1) // coarse)
    found = df.agg(F.percentile_approx(id_col, [i / coarse for i in range(coarse + 1)], 10000).alias("b"), F.count("*").alias("n"), F.count(id_col).alias("ids")).first()
    bounds = found["b"] or []
    unit = tie.cast("double") / F.lit(2.0**64) + F.lit(0.5)

    def cut(share: Column, base: int, ranges: int) -> Column:
        return F.lit(base) + F.least(F.greatest(F.floor(share * F.lit(float(ranges))), F.lit(0)), F.lit(ranges - 1))

    nulls = -(-n * (found["n"] - found["ids"]) // max(found["n"], 1)) if found["n"] else 0
    top = max(1, nulls)
    null_ids = cut(unit, 0, top)
    steps: list[tuple[object, bool, Column]] = []  # (from, whether beyond it, bucket)
    distinct = sorted(set(bounds))
    for i, v in enumerate(distinct):
        if (times := bounds.count(v)) > 1:
            steps.append((v, False, cut(unit, top, (times - 1) * fine)))
            top += (times - 1) * fine
        if i + 1 < len(distinct):
            width = F.lit(float(max(1, distinct[i + 1] - v)))
            steps.append((v, bounds.count(v) > 1, cut((F.col(id_col) - F.lit(v)).cast("double") / width, top, fine)))
            top += fine
    if not steps:
        steps, top = [(None, False, F.lit(top))], top + 1

    def tree(lo: int, hi: int) -> Column:
        if hi - lo <= 1:
            return steps[lo][2]
        mid = (lo + hi) // 2
        at, beyond, _ = steps[mid]
        return F.when(F.col(id_col) <= F.lit(at) if beyond else F.col(id_col) < F.lit(at), tree(lo, mid)).otherwise(tree(mid, hi))

    return F.when(F.col(id_col).isNull(), null_ids).otherwise(tree(0, len(steps))).cast("int"), top


def by_part(rows: DataFrame, n: int):
    """Rows grouped by their ``part`` (0 to n - 1, or below), each number dealt to the task of that number."""
    return rows.repartitionById(n, F.col("part")).groupBy("part")


def grouped(fn, **options):
    """``fn(table, **options)`` as applyInArrow takes it."""
    import pyarrow as pa

    def call(table: pa.Table) -> pa.Table:
        return fn(table, **options)

    call.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return call


def streamed(fn, **options):
    """``fn(batches, **options)``, a generator of batches, as applyInArrow takes it."""
    from collections.abc import Iterator

    import pyarrow as pa

    def call(batches):
        yield from fn(batches, **options)

    call.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return call


#: A key is hot if it holds more than this share of all rows; so there are at most 1 / HOT hot keys.
HOT = 1e-4


def join_copies(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """``rows`` joined to ``named``, which has one row for each ``key`` and counts its rows in ``copies``.

    Hot keys (at most 1 / HOT, whatever the size of the table) are broadcast and their rows stay where
    they are; all other rows meet their key by a shuffle in which no key is large.
    """
    least = HOT * (named.agg(F.sum("copies")).first()[0] or 0)
    hot, cold = named.where(F.col("copies") > least), named.where(F.col("copies") <= least)
    many = rows.join(F.broadcast(hot.drop("copies")), key)
    return many.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold.drop("copies"), key))


class Sets:
    """Union-find over any keys; the root of a set is its smallest key."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a, b) -> bool:
        """True if they were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


def components(edges: DataFrame, name: str, rounds: int | None = None) -> DataFrame:
    """Connected components of ``edges`` (a, b): (node, root), root the smallest node reachable.

    Goes on until a round changes nothing; if ``rounds`` are given and don't suffice, raises.

    Large-star and small-star rounds (Kiveris et al. 2014) as aggregates and joins; each round is
    written to the shared folder, so no plan grows and a lost executor costs one round at most. The
    per-node minimum is pre-aggregated before its shuffle and the join back to the edges is one that
    adaptive execution can split, so a centre with very many links does not fill one task.
    """
    spark, before = edges.sparkSession, None
    with scratch(spark) as keep:
        edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
        for i in itertools.count():
            if i == rounds:
                raise RuntimeError(f"links still change after {rounds} rounds")
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = written(large.where("a <> b").distinct(), name)
            low = edges.groupBy("a").agg(F.min("b").alias("m"))
            near = edges.join(low, "a").select("a", "b", "m")
            small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
            edges = written(small.where("a <> b").distinct(), name)
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if now == before:
                break
            before = now
        return keep(written(edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), name))
