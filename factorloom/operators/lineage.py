"""The record of a search as a table: run_id, id, generation, op, parents, tree, fitness."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files

SCHEMA = "run_id string, id bigint, generation int, op string, parents array<bigint>, tree string, fitness double"


def by_generation(lineage: DataFrame) -> DataFrame:
    """Best and mean fitness, and members, of each generation."""
    return lineage.groupBy("run_id", "generation").agg(F.max("fitness").alias("best"), F.avg("fitness").alias("mean"), F.count("*").alias("members"))


def by_method(lineage: DataFrame) -> DataFrame:
    """Per generation and breeding method: members, best fitness, id of the best (the smaller on a tie)."""
    method = F.split("op", r"\+")[0]
    return lineage.groupBy("run_id", "generation", method.alias("method")).agg(
        F.count("*").alias("members"), F.max("fitness").alias("best"), F.max_by("id", F.struct(F.coalesce("fitness", F.lit(float("-inf"))), -F.col("id"))).alias("best_id")
    )


def edges(lineage: DataFrame) -> DataFrame:
    """One row for each parent of a node: parent, child, op."""
    return lineage.select("run_id", F.explode("parents").alias("parent"), F.col("id").alias("child"), "op")


def layout(lineage: DataFrame) -> DataFrame:
    """Place of each node in its generation, by id."""
    return lineage.select("run_id", "id", "generation", (F.row_number().over(Window.partitionBy("run_id", "generation").orderBy("id")) - 1).alias("place"))


def save(lineage: DataFrame, path: str) -> None:
    """Adds a run's records to a table by run; a run that is saved again replaces its records."""
    lineage.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def load(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    df = spark.read.schema(SCHEMA).parquet(path).select(*(c.split()[0] for c in SCHEMA.split(", ")))
    return df if run_id is None else df.where(F.col("run_id") == run_id)


def replay(lineage: DataFrame, run_id: str) -> list[list[str]]:
    """A run's trees, generation by generation, in the order of the population."""
    rows = lineage.where(F.col("run_id") == run_id).groupBy("generation").agg(F.array_sort(F.collect_list(F.struct("id", "tree"))).alias("x")).orderBy("generation")
    return [[r["tree"] for r in g["x"]] for g in rows.collect()]


def current(lineage: DataFrame, run_id: str, generation: int | None = None) -> list[int]:
    """Ids of a generation (the last), in the order of the population: the parents that a run taken up refers to."""
    own = lineage.where(F.col("run_id") == run_id)
    if generation is None:
        generation = own.agg(F.max("generation")).first()[0]
    return [r["id"] for r in own.where(F.col("generation") == generation).orderBy("id").collect()]


#: Generations that one job goes back.
STEP = 8


def ancestors(lineage: DataFrame, start: int, run_id: str | None = None) -> DataFrame:
    """All nodes that led to a node, itself included.

    A job goes back STEP generations by frontier joins and writes what it found to the shared folder, so the plan
    is as long for any number of generations and nothing is held. Only nodes not found before go on, so a node
    that many descend from is gone through once. (A recursive query would give a row for each path to it.)
    """
    spark = lineage.sparkSession
    if run_id is not None:
        lineage = lineage.where(F.col("run_id") == run_id)
    top = files.scratch(spark, "ancestors")
    edges(lineage).select("parent", "child").distinct().write.parquet(f"{top}/edges")
    e = spark.read.schema("parent bigint, child bigint").parquet(f"{top}/edges")
    frontier = lineage.where(F.col("id") == start).select(F.col("id").alias("node"), F.lit(True).alias("edge")).distinct()
    for i in itertools.count():
        step = [frontier.select("node")]
        for _ in range(STEP):
            step.append(e.join(step[-1], e["child"] == step[-1]["node"], "left_semi").select(F.col("parent").alias("node")).distinct())
        found = step[0].withColumn("edge", F.lit(False))
        for k, s in enumerate(step[1:], 1):
            found = found.unionByName(s.withColumn("edge", F.lit(k == STEP)))
        found = found.groupBy("node").agg(F.max("edge").alias("edge"))  # edge: reached last, its parents aren't asked yet
        if i:
            found = found.join(spark.read.schema("node bigint, edge boolean").parquet(f"{top}/found"), "node", "left_anti")
        counted = Observation()
        found.observe(counted, F.count(F.when(F.col("edge"), 1)).alias("edge")).write.mode("append").parquet(f"{top}/found/step={i}")
        if not counted.get["edge"]:
            return spark.read.schema("node bigint, edge boolean, step int").parquet(f"{top}/found").select("node")
        frontier = spark.read.schema("node bigint, edge boolean").parquet(f"{top}/found/step={i}").where("edge")
