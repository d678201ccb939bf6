"""Key-value access paths; orders stand in for the table, o_orderkey for its key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import access
from tidemark.plans.registry import query
from tidemark.sources import table

COLS = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_get(spark, d):
    return table(spark, d, "orders").filter("o_orderkey = 7").select(*COLS)


@query("SELECT k.pos, k.o_orderkey, o.o_custkey, o.o_totalprice FROM (VALUES (0, 3), (1, 7), (2, 11), (3, -1)) k(pos, o_orderkey) LEFT JOIN orders o USING (o_orderkey)")
def multi_get(spark, d):
    return access.multi_get(spark, table(spark, d, "orders").select(*COLS), "o_orderkey", [3, 7, 11, -1]).select("pos", *COLS)


@query("SELECT k.o_orderkey, o.o_orderkey IS NOT NULL AS found FROM (VALUES (5), (-5), (12)) k(o_orderkey) LEFT JOIN orders o USING (o_orderkey)")
def probe_exists(spark, d):
    return access.exists(table(spark, d, "orders"), spark.createDataFrame([(5,), (-5,), (12,)], "o_orderkey long"), "o_orderkey")


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 20")
def scan_forward(spark, d):
    rows = access.scan(table(spark, d, "orders").select(*COLS), ["o_orderkey"], [10], [20])
    return rows.withColumn("pos", F.row_number().over(Window.orderBy("o_orderkey")))  # as many rows as the range has keys


@query("SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey DESC) AS pos FROM orders WHERE o_orderkey > 10 AND o_orderkey <= 20")
def scan_reverse(spark, d):
    rows = access.scan(table(spark, d, "orders").select(*COLS), ["o_orderkey"], [20], [10], reverse=True)
    return rows.withColumn("pos", F.row_number().over(Window.orderBy(F.col("o_orderkey").desc())))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 25")
def scan_limit(spark, d):
    return access.scan(table(spark, d, "orders").select(*COLS), ["o_orderkey"], [100], limit=25)


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (o_custkey > 10 OR (o_custkey = 10 AND o_orderkey >= 50)) AND (o_custkey < 14 OR (o_custkey = 14 AND o_orderkey < 9000))")
def scan_tuple_range(spark, d):
    return access.scan(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], [10, 50], [14, 9000])


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_key(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, CAST(arg_max(round(o_totalprice * 100), o_orderkey) AS BIGINT) AS cents FROM orders GROUP BY o_custkey")
def latest_key(spark, d):
    top = F.max(F.struct("o_orderkey", "o_totalprice"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(top.alias("t")).select("o_custkey", "t.o_orderkey", F.round(F.col("t.o_totalprice") * 100).cast("long").alias("cents"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS n_customers, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS cents FROM orders WHERE o_orderkey >= 10 AND o_orderkey < 1000")
def scan_fold(spark, d):
    rows = table(spark, d, "orders").filter(access.bound(["o_orderkey"], [10], ">=") & access.bound(["o_orderkey"], [1000], "<"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("n_customers"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 10 = 3 THEN 100 ELSE 0 END AS cents, o_orderkey % 10 = 3 AS changed FROM orders")
def read_modify_write(spark, d):
    changed = F.col("o_orderkey") % 10 == 3
    return table(spark, d, "orders").select("o_orderkey", (F.round(F.col("o_totalprice") * 100).cast("long") + F.when(changed, 100).otherwise(0)).alias("cents"), changed.alias("changed"))


@query("SELECT s.o_orderkey AS start, count(*) AS n, min(o.o_orderkey) AS low, max(o.o_orderkey) AS high FROM orders s JOIN orders o ON o.o_orderkey >= s.o_orderkey AND o.o_orderkey < s.o_orderkey + 1 + s.o_orderkey % 50 GROUP BY s.o_orderkey")
def scan_many(spark, d):
    """A short range scan from every key: each range is spread over the keys it may hold (50 at most), so they meet by equality."""
    keys = table(spark, d, "orders").select("o_orderkey")
    starts = keys.select(F.col("o_orderkey").alias("start"), F.explode(F.expr("sequence(o_orderkey, o_orderkey + o_orderkey % 50)")).alias("o_orderkey"))
    return starts.join(keys, "o_orderkey").groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
