"""The order-entry workload, as set-oriented queries over all keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import cents, last_name
from tidemark.operators import access
from tidemark.plans.registry import query
from tidemark.sources import table

LINE = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate"]


def stock(spark, d):
    """Stock level stand-in: quantity by supplier and part."""
    return table(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("qty"))


STOCK = "(SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)"


@query(f"""SELECT s.l_suppkey, count(DISTINCT s.l_partkey) AS low_parts FROM
(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_orderkey > (SELECT max(o_orderkey) FROM orders) - 200) r
JOIN {STOCK} s USING (l_suppkey, l_partkey) WHERE s.qty < 20 GROUP BY s.l_suppkey""")
def stock_level(spark, d):
    newest = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]  # one number, so that the range reaches the scan
    recent = table(spark, d, "lineitem").filter(F.col("l_orderkey") > newest - 200).select("l_suppkey", "l_partkey").distinct()
    return stock(spark, d).filter("qty < 20").join(recent, ["l_suppkey", "l_partkey"], "left_semi").groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("low_parts"))


@query("""SELECT o.o_custkey, o.o_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_shipdate FROM
(SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey""")
def order_status(spark, d):
    newest = table(spark, d, "orders").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), *LINE)
    return newest.join(lines, "o_orderkey", "left")


@query("""SELECT c_nationkey, c_mktsegment, c_custkey, c_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_name, c_custkey) AS r,
count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS n FROM customer) WHERE r = (n + 1) // 2""")
def customer_by_name_median(spark, d):
    return access.median_row(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], ["c_name", "c_custkey"]).select("c_nationkey", "c_mktsegment", "c_custkey", "c_name")


@query("""SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) + owed AS cents, CASE WHEN CAST(round(c_acctbal * 100) AS BIGINT) + owed > 50000000 THEN 'BC' ELSE 'GC' END AS credit
FROM customer JOIN (SELECT o_custkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS owed FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def credit_check(spark, d):
    open_orders = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey")
    owed = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), cents(F.col("l_extendedprice")).alias("c")).join(open_orders, "o_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("c").alias("owed"))
    total = cents(F.col("c_acctbal")) + F.col("owed")
    return table(spark, d, "customer").join(owed, "c_custkey").select("c_custkey", total.alias("cents"), F.when(total > 50000000, "BC").otherwise("GC").alias("credit"))


@query(f"""SELECT n_name, s_name, s_suppkey, p_partkey, p_name, qty, CASE WHEN qty < 15 THEN qty + 50 ELSE qty END AS restocked FROM
(SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY qty, l_partkey) AS r FROM {STOCK}) JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
JOIN region ON r_regionkey = n_regionkey JOIN part ON p_partkey = l_partkey WHERE r = 1 AND r_name = 'ASIA' AND NOT contains(p_name, 'b')""")
def query2_min_stock(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    least = stock(spark, d).groupBy("l_suppkey").agg(F.min(F.struct("qty", "l_partkey")).alias("m")).select("l_suppkey", "m.qty", "m.l_partkey")
    parts = table(spark, d, "part").filter(~F.col("p_name").contains("b"))
    out = suppliers.join(least, F.col("s_suppkey") == F.col("l_suppkey")).join(parts, F.col("p_partkey") == F.col("l_partkey"))
    return out.select("n_name", "s_name", "s_suppkey", "p_partkey", "p_name", "qty", F.when(F.col("qty") < 15, F.col("qty") + 50).otherwise(F.col("qty")).alias("restocked"))


@query("""SELECT s_suppkey, count(*) AS n_pairs, sum(qty)::BIGINT AS qty FROM supplier JOIN (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL)
ON (l_suppkey * l_partkey) % 100 = s_suppkey GROUP BY s_suppkey""")
def supplier_by_expression(spark, d):
    """An equi-join on a computed key."""
    pairs = stock(spark, d).withColumn("k", (F.col("l_suppkey") * F.col("l_partkey")) % 100)
    return table(spark, d, "supplier").join(pairs, F.col("k") == F.col("s_suppkey")).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("qty").cast("long").alias("qty"))


@query("SELECT c_nationkey, min(o_orderkey) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY c_nationkey")
def oldest_undelivered(spark, d):
    waiting = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return waiting.join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey").groupBy("c_nationkey").agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS ordered, count(*) AS order_cnt, sum(CAST(round(l_quantity * p_retailprice * 100) AS BIGINT))::BIGINT AS amount_cents,
((100 - sum(l_quantity)::BIGINT) % 91 + 91) % 91 + 10 AS new_qty FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL""")
def new_order_pricing(spark, d):
    """New orders: each line's amount from the part's price, and each stock row rolled forward once by all its lines; a level
    that falls under 10 is refilled by 91 until it is in [10, 100]."""
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    total = F.sum("l_quantity").cast("long")
    return table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_quantity").join(prices, "l_partkey").groupBy("l_suppkey", "l_partkey").agg(total.alias("ordered"), F.count(F.lit(1)).alias("order_cnt"), F.sum(cents(F.col("l_quantity") * F.col("p_retailprice"))).alias("amount_cents"), (F.pmod(F.lit(100) - total, F.lit(91)) + 10).alias("new_qty"))


@query("""SELECT c_custkey, c_nationkey, CAST(round(c_acctbal * 100) AS BIGINT) - paid AS balance_cents, paid, n, sum(paid) OVER (PARTITION BY c_nationkey)::BIGINT AS nation_ytd FROM customer JOIN
(SELECT o_custkey, sum(CAST(round(o_totalprice * 100) AS BIGINT))::BIGINT AS paid, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def payment_totals(spark, d):
    paid = table(spark, d, "orders").filter("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(cents(F.col("o_totalprice"))).alias("paid"), F.count(F.lit(1)).alias("n"))
    rows = table(spark, d, "customer").join(paid, "c_custkey").select("c_custkey", "c_nationkey", (cents(F.col("c_acctbal")) - F.col("paid")).alias("balance_cents"), "paid", "n")
    ytd = rows.groupBy("c_nationkey").agg(F.sum("paid").alias("nation_ytd"))
    return rows.join(ytd, "c_nationkey")


@query("""SELECT c_custkey, left('Customer ' || CAST(c_custkey AS VARCHAR) || ' pays ' || c_mktsegment, 24) AS h_data FROM customer""")
def payment_history_text(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.left(F.format_string("Customer %d pays %s", "c_custkey", "c_mktsegment"), F.lit(24)).alias("h_data"))


@query("""SELECT o.o_orderkey, o.o_custkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS amount_cents, count(*) AS n_lines FROM
(SELECT c_nationkey, min(o_orderkey) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY c_nationkey) m
JOIN orders o USING (o_orderkey) JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY ALL""")
def delivery_effects(spark, d):
    """Deliver the oldest open order of each nation: its customer's balance grows by the sum of its lines."""
    due = oldest_undelivered(spark, d).select("o_orderkey")
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), cents(F.col("l_extendedprice")).alias("c"))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(due, "o_orderkey").join(lines, "o_orderkey").groupBy("o_orderkey", "o_custkey").agg(F.sum("c").alias("amount_cents"), F.count(F.lit(1)).alias("n_lines"))


@query("""SELECT l_suppkey, l_partkey, qty, r FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS r FROM (SELECT l_suppkey, l_partkey, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ALL)) WHERE r <= 10""")
def micro_range_read(spark, d):
    """Sequential reads of the first ten stock rows of each supplier."""
    rows = stock(spark, d).withColumn("qty", F.col("qty").cast("long"))
    return access.first_per(rows, ["l_suppkey"], ["l_partkey"], 10, rank="r")


@query("""SELECT c_custkey, list_extract(s, c_custkey // 100 % 10 + 1) || list_extract(s, c_custkey // 10 % 10 + 1) || list_extract(s, c_custkey % 10 + 1) AS last_name
FROM customer, (SELECT ['BAR','OUGHT','ABLE','PRI','PRES','ESE','ANTI','CALLY','ATION','EING'] AS s)""")
def customer_last_name(spark, d):
    return table(spark, d, "customer").select("c_custkey", last_name(F.col("c_custkey")).alias("last_name"))


@query("""SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)""")
def hot_cold_except(spark, d):
    """Parts that no line of 50 or more, of any order, holds."""
    hot = table(spark, d, "lineitem").filter("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").select("p_partkey").join(hot, "p_partkey", "left_anti")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r <= 3""")
def last_orders(spark, d):
    return access.first_per(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 3, last=True)


@query("""SELECT count(*) FILTER (WHERE l_linenumber NOT BETWEEN 1 AND 15) AS bad_lines, count(*) FILTER (WHERE l_quantity <= 0) AS bad_qty, (SELECT count(*) FROM region) AS n_region, (SELECT count(*) FROM nation) AS n_nation FROM lineitem""")
def invariants(spark, d):
    """The value-domain checks of the loaders, over whole tables."""
    lines = table(spark, d, "lineitem").agg(F.count_if(~F.col("l_linenumber").between(1, 15)).alias("bad_lines"), F.count_if(F.col("l_quantity") <= 0).alias("bad_qty"))
    counts = [table(spark, d, n).agg(F.count(F.lit(1)).alias(f"n_{n}")) for n in ("region", "nation")]
    parts = [x.withColumn("_one", F.lit(1)) for x in (lines, *counts)]  # one row each
    return parts[0].join(parts[1], "_one").join(parts[2], "_one").drop("_one")
