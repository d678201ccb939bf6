"""Band and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def band_join(df: DataFrame, bands: DataFrame, value: str, low: str, high: str, width: float, on: Sequence[str] = ()) -> DataFrame:
    """Rows with each band whose inclusive [low, high] holds their value.

    Bands are cut into cells of the given width and joined on the cell, so it is
    an equi-join at any size. Each row has one cell, so no pair comes twice.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(width))
    cut = bands.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    return df.withColumn("_cell", cell(value)).join(cut, ["_cell", *on]).filter(F.col(value).between(F.col(low), F.col(high))).drop("_cell")


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, values: Sequence[str], cell: float | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its key at or before it: one shuffle, no range join.

    With `cell`, in the unit of the times (seconds, for timestamps), a key is cut into cells of time which are sorted apart, so that no
    task sorts a whole key; what a cell begins with is the last right row of the cells before it, one row a cell.
    """
    a = left.withColumns({"_ts": F.col(left_ts), "_side": F.lit(1), "_v": F.lit(None)})
    b = right.select(*by, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*values).alias("_v"))
    both, keys = a.unionByName(b, allowMissingColumns=True), list(by)
    before = F.lit(None)
    if cell:
        keys, at = [*by, "_cell"], F.col("_ts")
        if left.schema[left_ts].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
            at = at.cast("timestamp")
        both = both.withColumn("_cell", F.floor(at.cast("double") / F.lit(cell)))
        lasts = both.groupBy(*keys).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.col("_ts"))).alias("_before"))
        order = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        lasts = lasts.withColumn("_before", F.last("_before", ignorenulls=True).over(order))
        lasts = lasts.toDF(*[f"_{c}_of" for c in keys], "_before")
        both, before = both.join(lasts, [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in keys], "left"), F.col("_before")
    w = Window.partitionBy(*keys).orderBy("_ts", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_last", F.coalesce(F.last("_v", ignorenulls=True).over(w), before)).filter("_side = 1")
    return out.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])
