"""File sources and sinks. Everything is Parquet unless it is a seed file or a list of counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.sources.scratch import filesystem

STAMP = "commit_ts"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; column pruning and filters reach the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_flat(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A tab-separated seed file without a header, read with an explicit schema."""
    return spark.read.csv(path, sep="\t", schema=schema, header=False, mode="FAILFAST")


def write_counters(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """Counters (seconds, commits, aborts and the like) as one CSV file with a header, in order; there are as many rows as seconds."""
    rows.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)


def claim(spark: SparkSession, path: str, commit_ts: int) -> bool:
    """Take a commit stamp; False if another writer has it. The store creates the file for one caller alone."""
    fs, where = filesystem(spark, f"{path}/_claims/{commit_ts}")
    try:
        return bool(fs.createNewFile(where))
    except Exception as e:  # some stores raise where others answer
        if "FileAlreadyExists" in str(e):
            return False
        raise


def complete(spark: SparkSession, path: str, prefix: str = STAMP) -> list[int]:
    """The numbers of the folders prefix=N whose write has ended, ascending."""
    fs, where = filesystem(spark, path)
    if not fs.exists(where):
        return []
    names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(where)]
    return sorted(int(n.split("=")[1]) for n, p in names if n.startswith(f"{prefix}=") and fs.exists(filesystem(spark, f"{p}/_SUCCESS")[1]))


def append_log(staged: DataFrame, path: str, commit_ts: int) -> None:
    """Append one committed batch of changes in the folder of its stamp; fails if the stamp has one already."""
    staged.drop(STAMP).write.mode("error").parquet(f"{path}/{STAMP}={commit_ts}")


def read_log(spark: SparkSession, path: str, read_ts: int | None = None, after: int | None = None) -> DataFrame:
    """The change log of all commits whose write has ended, pruned to those visible at read_ts and later than `after`."""
    stamps = complete(spark, path)
    schema = StructType([*spark.read.parquet(f"{path}/{STAMP}={stamps[0]}").schema.fields, StructField(STAMP, LongType(), False)])
    wanted = [f"{path}/{STAMP}={n}" for n in stamps if (read_ts is None or n <= read_ts) and (after is None or n > after)]
    if not wanted:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*wanted)


def write_snapshot(snapshot: DataFrame, path: str, ts: int) -> str:
    """A checkpoint: the latest versions at ts, in a folder named by ts."""
    snapshot.write.mode("overwrite").parquet(out := f"{path}/snapshot_ts={ts}")
    return out
