"""Loading with read-back, run metrics, and sequential access that wraps around."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.versions import Result, VersionedTable
from tidemark.sources import write_counters


def fingerprint(rows: DataFrame) -> tuple:
    """The number of rows and a sum over their values that doesn't depend on their order."""
    return tuple(rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))).first())


def bulk_load(spark: SparkSession, table: VersionedTable, rows: DataFrame, batches: int = 1) -> None:
    """Commit rows in batches, by key, then read the table back; ValueError if a batch is refused or the table isn't what was loaded."""
    part = F.pmod(F.xxhash64(*table.keys), F.lit(batches))
    for i in range(batches):
        if (found := table.commit(spark, rows.filter(part == i).withColumn("op", F.lit("I")), table.watermark(spark))) is not Result.OK:
            raise ValueError(f"batch {i}: {found.value}")
    if fingerprint(table.at(spark).select(*rows.columns)) != fingerprint(rows):
        raise ValueError("what was read back differs from what was loaded")


def totals(runs: DataFrame, by: str) -> DataFrame:
    """by, commits, aborts, rate (commits a second) and latency of runs (by, ts, failed, latency)."""
    span = F.max("ts").cast("double") - F.min("ts").cast("double")
    commits = F.count_if(~F.col("failed"))
    return runs.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(by).agg(commits.alias("commits"), F.count_if("failed").alias("aborts"), F.round(commits / span, 9).alias("rate"), F.round(F.avg("latency"), 6).alias("latency"))


def counters(runs: DataFrame, path: str, every: int = 1) -> DataFrame:
    """sec (from the first run on, in steps of `every` seconds), commits and aborts, written as counters to path and read back."""
    start = runs.agg(F.min(F.col("ts").cast("timestamp")).cast("double")).first()[0] or 0.0  # one number
    sec = F.floor((F.col("ts").cast("timestamp").cast("double") - F.lit(start)) / every).cast("long")
    rows = runs.groupBy(sec.alias("sec")).agg(F.count_if(~F.col("failed")).alias("commits"), F.count_if("failed").alias("aborts"))
    write_counters(rows, path, ["sec"])
    return runs.sparkSession.read.csv(path, header=True, schema="sec long, commits long, aborts long")


def wraparound(rows: DataFrame, by: Sequence[str], order: Sequence[str], start: Column, n: int) -> DataFrame:
    """n rows of each group in key order from the place `start` (modulo the group's size) on, going on with the first ones; step counts from 0."""
    w = Window.partitionBy(*by)
    placed = rows.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return placed.withColumn("step", F.pmod(F.col("_r") - F.pmod(start, F.col("_n")), F.col("_n"))).filter(F.col("step") < n).drop("_r", "_n")
