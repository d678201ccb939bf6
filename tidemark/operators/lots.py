"""First-in-first-out and last-in-first-out lot matching, without loops.

Lots and sells of one account and symbol are laid end to end on two number
lines by running sums; a sell takes from a lot where their intervals overlap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(df: DataFrame, by: Sequence[str], order: Sequence[Column], qty: str, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(qty).over(w)
    return df.withColumn(f"{name}_end", end).withColumn(f"{name}_start", F.col(f"{name}_end") - F.col(qty))


def consume(lots: DataFrame, by: Sequence[str], order: Sequence[str], qty: str, need: Column, lifo: bool = False) -> DataFrame:
    """What one need for each group takes from each lot (taken) and what stays (after_qty), oldest or newest lots first."""
    cols = [F.col(c).desc() if lifo else F.col(c).asc() for c in order]
    out = _line(lots, by, cols, qty, "lot")
    taken = F.greatest(F.lit(0.0), F.least(F.col(qty), need - F.col("lot_start")))
    return out.withColumn("taken", taken).withColumn("after_qty", F.col(qty) - F.col("taken")).drop("lot_start", "lot_end")


def match(lots: DataFrame, sells: DataFrame, by: Sequence[str], lot_order: Sequence[str], sell_order: Sequence[str], qty: str, sell_qty: str, lifo: bool = False) -> DataFrame:
    """Several sells against the same lots: one row for each lot and sell that overlap, with the matched quantity.

    LIFO here lays the lots newest first; the sells are served in their own order. Both lines are merged: between two neighbouring ends lies one
    piece of one lot and one sell. So a group costs a sort of its lots and sells, whatever its size, and not their pairs.
    """
    a = _line(lots, by, [F.col(c).desc() if lifo else F.col(c).asc() for c in lot_order], qty, "lot")
    b = _line(sells, by, [F.col(c) for c in sell_order], sell_qty, "sell")
    lot, sell = [c for c in lots.columns if c not in by], [c for c in sells.columns if c not in by]
    ends = a.select(*by, F.col("lot_end").alias("_at"), F.struct(*lot).alias("_lot")).unionByName(b.select(*by, F.col("sell_end").alias("_at"), F.struct(*sell).alias("_sell")), allowMissingColumns=True)
    # downward, the last lot and sell met are those that reach over the place
    down = Window.partitionBy(*by).orderBy(F.col("_at").desc())
    met = down.rowsBetween(Window.unboundedPreceding, 0)
    pieces = ends.select(*by, (F.col("_at") - F.coalesce(F.lead("_at").over(down), F.lit(0.0))).alias("matched"), *[F.last(c, ignorenulls=True).over(met).alias(c) for c in ("_lot", "_sell")])
    pieces = pieces.filter((F.col("matched") > 0) & F.col("_lot").isNotNull() & F.col("_sell").isNotNull())
    return pieces.select(*by, *[f"_lot.{c}" for c in lot], *[f"_sell.{c}" for c in sell], "matched")
