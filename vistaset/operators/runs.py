"""Runs of the engine: what each one found changed, and how many could use the library as it was."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import etl

RUNS = "run bigint, files bigint, changed bigint, deleted bigint, hit boolean"


def observed(old: DataFrame, new: DataFrame) -> tuple[DataFrame, Observation]:
    """The changes between two listings, and the numbers that Spark observes while they are used, without a pass of their own."""
    o = Observation()
    count = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1))
    return etl.changes(old, new).observe(o, count("added", "modified", "same").alias("files"), count("added", "modified").alias("changed"), count("deleted").alias("deleted")), o


def record(spark: SparkSession, folder: str, run: int, seen: Observation) -> None:
    """Write a run's row; a run that is recorded again replaces it. A run is a hit if nothing had to be built or removed."""
    n = seen.get
    row = spark.createDataFrame([(run, n["files"], n["changed"], n["deleted"], n["changed"] + n["deleted"] == 0)], RUNS)
    row.coalesce(1).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/of={run}")


def history(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RUNS).parquet(folder).drop("of")


def hit_ratio(runs: DataFrame) -> DataFrame:
    """One row: runs, hits, ratio; no runs have a null ratio."""
    hits = F.count(F.when(F.col("hit"), 1))
    return runs.agg(F.count(F.lit(1)).alias("runs"), hits.alias("hits"), (hits / F.nullif(F.count(F.lit(1)), F.lit(0))).alias("ratio"))
