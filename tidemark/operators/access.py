"""Point, multi-key and ordered range access.

An index is a column list and a sort order; nothing is stored for it. Ranges
are expanded into flat comparisons, which the Parquet scan can evaluate on its
statistics (a comparison of structs isn't pushed down).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import saved


def bound(cols: Sequence[str], values: Sequence, op: str) -> Column:
    """The tuple comparison (cols) op (values), op one of < <= > >=, in lexicographic order."""
    strict = {"<": Column.__lt__, "<=": Column.__lt__, ">": Column.__gt__, ">=": Column.__gt__}[op]
    terms = []
    for i, (c, v) in enumerate(zip(cols, values, strict=True)):
        last = i == len(cols) - 1
        here = getattr(F.col(c), {"<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}[op])(F.lit(v)) if last else strict(F.col(c), F.lit(v))
        terms.append(reduce(Column.__and__, [F.col(p) == F.lit(w) for p, w in zip(cols[:i], values[:i], strict=True)], F.lit(True)) & here)
    return reduce(Column.__or__, terms)


def scan(df: DataFrame, cols: Sequence[str], start=None, end=None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """Rows of the key range in key order: [start, end) ascending, or (end, start] descending; None is unbounded."""
    low, high = (">=", "<") if not reverse else ("<=", ">")
    for at, op in ((start, low), (end, high)):
        if at is not None:
            df = df.filter(bound(cols, at, op))
    out = df.orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in cols])
    return out if limit is None else out.limit(limit)


def pull(df: DataFrame, cols: Sequence[str], start=None, end=None, reverse: bool = False) -> Iterator[Row]:
    """A range in key order, row by row, for a caller who may stop at any time: partitions come to the driver one at a time, as they are asked for."""
    return scan(df, cols, start, end, reverse).toLocalIterator()


def multi_get(spark: SparkSession, df: DataFrame, key: str, keys: Sequence, kind: str = "long") -> DataFrame:
    """One row for each requested key, in request order (column pos); a miss has null values.

    The scan is reduced by the keys before the join: they're literals, so they are pushed down.
    """
    asked = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], f"pos int, {key} {kind}")
    return asked.join(df.filter(F.col(key).isin(*keys)), key, "left")


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int = 1, last: bool = False, rank: str | None = None) -> DataFrame:
    """The first (or last) n rows of each group in key order. Spark prunes each task's groups to n rows before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*[F.col(c).desc() if last else F.col(c).asc() for c in order])
    out = df.withColumn(rank or "_rank", F.row_number().over(w)).filter(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def median_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row at position ceil(n/2) of each group in the given order."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    return ranked.filter(F.col("_rank") == F.floor((F.col("_n") + 1) / 2)).drop("_rank")


def exists(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """An index probe: each key with found true or false, reading only the key column."""
    return keys.join(df.select(key).distinct().withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def ranked(df: DataFrame, order: Sequence[Column], rank: str = "pos") -> DataFrame:
    """Each row with its place, from 1, in the order of the whole table; no task sees more than a range of it.

    Rows are dealt by range and numbered inside their range; only the ranges' sizes, one row a task, are added up in one place.
    """
    dealt = saved(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").withColumn(rank, place).drop("_range", "_before")
