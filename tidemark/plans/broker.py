"""The brokerage workload. Stand-ins: supplier = broker, customer = account, lineitem joined with orders = trade,
(customer, part) = account and symbol, p_retailprice = last price."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import cents, pct_change, toggle
from tidemark.operators import access, bands, lots
from tidemark.plans.registry import query
from tidemark.sources import table

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
TRADE_SQL = "(SELECT l.*, o_custkey FROM lineitem l JOIN orders ON o_orderkey = l_orderkey)"
day = lambda c: F.date_format(c, "yyyy-MM-dd")


def trades(spark, d, *cols):
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return table(spark, d, "lineitem").select("l_orderkey", *[c for c in cols if c != "l_orderkey"]).join(keys, "l_orderkey")


@query("""SELECT s_suppkey, s_name, volume, rank() OVER (ORDER BY volume DESC, s_suppkey) AS pos FROM (SELECT s_suppkey, s_name, sum(CAST(round(l_quantity * l_extendedprice * 100) AS BIGINT))::BIGINT AS volume
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE' GROUP BY ALL)""")
def broker_volume(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    brokers = table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    volume = F.sum(F.round(F.col("l_quantity") * F.col("l_extendedprice") * 100).cast("long"))
    sums = table(spark, d, "lineitem").join(brokers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_suppkey", "s_name").agg(volume.alias("volume"))
    return access.ranked(sums, [F.col("volume").desc(), F.col("s_suppkey").asc()])


@query(f"""SELECT c_custkey, coalesce(n, 0) AS n_holdings, coalesce(assets, 0) AS asset_cents FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(round(l_quantity * p_retailprice * 100) AS BIGINT))::BIGINT AS assets
FROM {TRADE_SQL} JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= TIMESTAMP '2001-06-01' GROUP BY o_custkey) ON o_custkey = c_custkey""")
def customer_position(spark, d):
    held = trades(spark, d, "l_partkey", "l_quantity", "l_shipdate").filter("l_shipdate >= timestamp '2001-06-01'")
    priced = held.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    sums = priced.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("l_quantity") * F.col("p_retailprice") * 100).cast("long")).alias("assets"))
    return table(spark, d, "customer").select("c_custkey").join(sums, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_holdings"), F.coalesce("assets", F.lit(0)).alias("asset_cents"))


@query("""SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r <= 10""")
def customer_recent_trades(spark, d):
    return access.first_per(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 10, last=True, rank="r").drop("o_orderdate")


WATCHED = """SELECT {0}, round(CASE WHEN old <> 0 THEN 100 * (new / old - 1) ELSE 0 END, 6) AS pct FROM (SELECT {0}, sum(p_size * CAST(round(p_retailprice * 100) AS BIGINT))::DOUBLE AS new,
sum(p_size * (CAST(round(p_retailprice * 100) AS BIGINT) - p_partkey % 100))::DOUBLE AS old FROM ({1}) JOIN part ON p_partkey = l_partkey GROUP BY {0})"""


def _watched(spark, d, by, watch):
    """Percent change of the summed value of each watch list (by, l_partkey), distinct."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size", cents(F.col("p_retailprice")).alias("now"))
    out = watch.join(parts, "l_partkey").groupBy(by).agg(F.sum(F.col("p_size") * F.col("now")).cast("double").alias("new"), F.sum(F.col("p_size") * (F.col("now") - F.col("l_partkey") % 100)).cast("double").alias("old"))
    return out.select(by, F.round(pct_change(F.col("new"), F.col("old")), 6).alias("pct"))


@query(WATCHED.format("c_nationkey", "SELECT DISTINCT c_nationkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey"))
def market_watch(spark, d):
    """By watch list: a nation's is the parts of its customers' orders."""
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return _watched(spark, d, "c_nationkey", trades(spark, d, "l_partkey").join(owners, "o_custkey").select("c_nationkey", "l_partkey").distinct())


@query(WATCHED.format("p_type", "SELECT p_type AS p_type, p_partkey AS l_partkey FROM part").replace("SELECT p_type, sum", "SELECT part.p_type, sum").replace("GROUP BY p_type)", "GROUP BY part.p_type)"))
def market_watch_industry(spark, d):
    """By industry: all parts of a type."""
    return _watched(spark, d, "p_type", table(spark, d, "part").select("p_type", F.col("p_partkey").alias("l_partkey")))


@query(WATCHED.format("o_custkey", "SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey"))
def market_watch_account(spark, d):
    """By account: the parts that it holds."""
    return _watched(spark, d, "o_custkey", trades(spark, d, "l_partkey").select("o_custkey", "l_partkey").distinct())


BANDS = [(1, 10, 0.01), (11, 25, 0.008), (26, 50, 0.005)]
BANDS_SQL = "(VALUES (1, 10, 0.01), (11, 25, 0.008), (26, 50, 0.005)) b(from_qty, to_qty, rate)"


@query(f"SELECT from_qty, count(*) AS n, sum(l_quantity)::BIGINT AS qty FROM lineitem JOIN {BANDS_SQL} ON l_quantity BETWEEN from_qty AND to_qty GROUP BY from_qty")
def commission_band(spark, d):
    rates = spark.createDataFrame(BANDS, "from_qty int, to_qty int, rate double")
    return bands.band_join(table(spark, d, "lineitem").select("l_quantity"), rates, "l_quantity", "from_qty", "to_qty", 10).groupBy("from_qty").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("qty"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_tax), 4) AS tax, sum(CAST(round(l_extendedprice * l_tax * 100) AS BIGINT))::BIGINT AS tax_cents FROM lineitem GROUP BY ALL""")
def tax_sum(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_tax"), 4).alias("tax"), F.sum(F.round(F.col("l_extendedprice") * F.col("l_tax") * 100).cast("long")).alias("tax_cents"))


@query("""SELECT o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') WHERE r = 1""")
def first_trade_since(spark, d):
    rows = table(spark, d, "orders").filter("o_orderdate >= timestamp '2000-01-01'").select("o_custkey", "o_orderdate", "o_orderkey")
    return access.first_per(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", day("o_orderdate").alias("day"), "o_orderkey")


def _lots(spark, d):
    rows = trades(spark, d, "l_partkey", *ORDER)
    many = rows.groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum("l_quantity") / 2)).alias("need")).filter("n > 1")
    return rows.join(many, ["o_custkey", "l_partkey"])


def _lots_sql(way: str) -> str:
    order = ", ".join(f"{c} {way}" for c in ORDER)
    return f"""SELECT o_custkey, l_partkey, l_orderkey, l_linenumber, l_suppkey, l_quantity, greatest(0, least(l_quantity, need - (cum - l_quantity))) AS taken, l_quantity - greatest(0, least(l_quantity, need - (cum - l_quantity))) AS after_qty
FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY o_custkey, l_partkey ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS cum, count(*) OVER (PARTITION BY o_custkey, l_partkey) AS n,
floor(sum(l_quantity) OVER (PARTITION BY o_custkey, l_partkey) / 2) AS need FROM {TRADE_SQL}) WHERE n > 1"""


LOT_COLS = ["o_custkey", "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "taken", "after_qty"]


@query(_lots_sql("ASC"))
def fifo_lots(spark, d):
    return lots.consume(_lots(spark, d), ["o_custkey", "l_partkey"], ORDER, "l_quantity", F.col("need")).select(*LOT_COLS)


@query(_lots_sql("DESC"))
def lifo_lots(spark, d):
    return lots.consume(_lots(spark, d), ["o_custkey", "l_partkey"], ORDER, "l_quantity", F.col("need"), lifo=True).select(*LOT_COLS)


@query("""WITH t AS (SELECT o_custkey, l_linestatus AS side, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate, l_discount, l_tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
x AS (SELECT *, sum(l_quantity) OVER (PARTITION BY o_custkey, side ORDER BY o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_shipdate, l_discount, l_tax ROWS UNBOUNDED PRECEDING) AS e FROM t)
SELECT a.o_custkey, a.o_orderkey AS buy_key, b.o_orderkey AS sell_key, sum(least(a.e, b.e) - greatest(a.e - a.l_quantity, b.e - b.l_quantity))::BIGINT AS matched FROM x a JOIN x b ON a.o_custkey = b.o_custkey AND a.side = 'O' AND b.side = 'F'
AND a.e - a.l_quantity < b.e AND b.e - b.l_quantity < a.e GROUP BY ALL""")
def lot_matching(spark, d):
    """Many sells (status F) against many buys (status O) of one account, first in first out."""
    order = ["o_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate", "l_discount", "l_tax"]
    rows = trades(spark, d, "l_linestatus", *order[1:]).withColumnRenamed("l_orderkey", "o_orderkey")
    sells = rows.filter("l_linestatus = 'F'").select("o_custkey", *[F.col(c).alias(f"s_{c}") for c in order])
    out = lots.match(rows.filter("l_linestatus = 'O'"), sells, ["o_custkey"], order, [f"s_{c}" for c in order], "l_quantity", "s_l_quantity")
    return out.groupBy("o_custkey", F.col("o_orderkey").alias("buy_key"), F.col("s_o_orderkey").alias("sell_key")).agg(F.sum("matched").cast("long").alias("matched"))


@query(f"""SELECT o_orderkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT) - CAST(round(l_extendedprice * l_tax * 100) AS BIGINT) - CAST(round(l_extendedprice * rate * 100) AS BIGINT))::BIGINT AS settle_cents, strftime(max(l_shipdate) + INTERVAL 2 DAY, '%Y-%m-%d') AS due
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN {BANDS_SQL} ON l_quantity BETWEEN from_qty AND to_qty GROUP BY o_orderkey""")
def settlement_amount(spark, d):
    """Trade value less tax and commission; due two days later."""
    rates = spark.createDataFrame(BANDS, "from_qty int, to_qty int, rate double")
    rows = bands.band_join(trades(spark, d, "l_quantity", "l_extendedprice", "l_tax", "l_shipdate"), rates, "l_quantity", "from_qty", "to_qty", 10)
    part = lambda x: F.round(F.col("l_extendedprice") * x * 100).cast("long")
    net = cents(F.col("l_extendedprice")) - part(F.col("l_tax")) - part(F.col("rate"))
    return rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(net).alias("settle_cents"), day(F.date_add(F.max("l_shipdate"), 2)).alias("due"))


@query("""SELECT o_orderkey, o_custkey, c_name, n_name, o_orderstatus, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE r <= 50""")
def trade_status(spark, d):
    recent = access.first_per(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 50, last=True, rank="r")
    who = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return recent.join(who, F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "o_custkey", "c_name", "n_name", "o_orderstatus", "r")


@query("""SELECT k.pos, o_orderkey, o_custkey, n_lines, CASE WHEN o_orderstatus = 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS cash_cents FROM (VALUES (0, 1), (1, 5), (2, 9), (3, 12)) k(pos, key) JOIN orders ON o_orderkey = key
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""")
def trade_lookup_ids(spark, d):
    keys = [1, 5, 9, 12]
    found = access.multi_get(spark, table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), "o_orderkey", keys).filter("o_custkey is not null")
    lines = table(spark, d, "lineitem").filter(F.col("l_orderkey").isin(*keys)).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return found.join(lines, "o_orderkey", "left").select("pos", "o_orderkey", "o_custkey", "n_lines", F.when(F.col("o_orderstatus") == "F", cents(F.col("o_totalprice"))).alias("cash_cents"))


@query("""SELECT o_custkey, o_orderkey, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01') WHERE r <= 20""")
def trade_lookup_account(spark, d):
    rows = table(spark, d, "orders").filter("o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1999-01-01'").select("o_custkey", "o_orderdate", "o_orderkey")
    return access.first_per(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], 20, rank="r").drop("o_orderdate")


@query("""SELECT l_partkey, l_orderkey, l_suppkey, l_linenumber, r FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') WHERE r <= 20""")
def trade_lookup_symbol(spark, d):
    rows = table(spark, d, "lineitem").filter("l_shipdate >= timestamp '1998-01-01'")
    return access.first_per(rows, ["l_partkey"], ORDER, 20, rank="r").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "r")


@query(f"""SELECT o_custkey, l_partkey, n, first_day, before_qty, after_qty FROM (SELECT o_custkey, l_partkey, count(*) OVER w AS n, strftime(first_value(l_shipdate) OVER x, '%Y-%m-%d') AS first_day, (sum(l_quantity) OVER (PARTITION BY o_custkey, l_partkey) - l_quantity)::BIGINT AS before_qty,
(sum(l_quantity) OVER (PARTITION BY o_custkey, l_partkey))::BIGINT AS after_qty, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS r
FROM {TRADE_SQL} WINDOW w AS (PARTITION BY o_custkey, l_partkey), x AS (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate)) WHERE r = 1 AND n > 1""")
def holding_history(spark, d):
    """Quantity before and after the last trade of each account and symbol with several trades."""
    last = F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"))
    out = trades(spark, d, "l_partkey", "l_shipdate", "l_linenumber", "l_suppkey", "l_quantity").groupBy("o_custkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), day(F.min("l_shipdate")).alias("first_day"), F.sum("l_quantity").alias("q"), last.alias("t"))
    return out.filter("n > 1").select("o_custkey", "l_partkey", "n", "first_day", (F.col("q") - F.col("t.l_quantity")).cast("long").alias("before_qty"), F.col("q").cast("long").alias("after_qty"))


@query("""SELECT p_partkey, p_name, p_brand, n_competitors, n_suppliers, n_trades, strftime(last_day, '%Y-%m-%d') AS last_day FROM part JOIN (SELECT p_type, p_brand, count(*) - 1 AS n_competitors FROM part GROUP BY ALL) USING (p_type, p_brand)
LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS n_suppliers, count(*) AS n_trades, max(l_shipdate) AS last_day FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""")
def security_detail(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    rivals = part.groupBy("p_type", "p_brand").agg((F.count(F.lit(1)) - 1).alias("n_competitors"))
    facts = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_suppkey").alias("n_suppliers"), F.count(F.lit(1)).alias("n_trades"), day(F.max("l_shipdate")).alias("last_day"))
    return part.join(rivals, ["p_type", "p_brand"]).join(facts, "p_partkey", "left").drop("p_type")


@query(f"""WITH k AS (SELECT min(c_custkey) + (max(c_custkey) - min(c_custkey)) // 5 AS low, min(c_custkey) + (max(c_custkey) - min(c_custkey)) // 5 * 2 AS high FROM customer)
SELECT min(o_custkey) AS start_id, max(o_custkey) AS end_id, sum(CAST(round(l_quantity * p_retailprice * 100) AS BIGINT))::BIGINT AS total_cents, count(DISTINCT o_custkey) AS n_accounts FROM {TRADE_SQL} JOIN part ON p_partkey = l_partkey, k WHERE o_custkey >= low AND o_custkey < high""")
def long_query_assets(spark, d):
    """The asset audit over the second fifth of the accounts: its history row."""
    low, high = table(spark, d, "customer").agg(F.min("c_custkey"), F.max("c_custkey")).first()  # two numbers
    start, end = low + (high - low) // 5, low + (high - low) // 5 * 2
    rows = trades(spark, d, "l_partkey", "l_quantity").filter((F.col("o_custkey") >= start) & (F.col("o_custkey") < end))
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return rows.join(prices, "l_partkey").agg(F.min("o_custkey").alias("start_id"), F.max("o_custkey").alias("end_id"), F.sum(cents(F.col("l_quantity") * F.col("p_retailprice"))).alias("total_cents"), F.countDistinct("o_custkey").alias("n_accounts"))


@query("""SELECT p_partkey, CASE WHEN r <= 20 THEN CASE WHEN contains(p_name, 'small') THEN replace(p_name, 'small', 'large') ELSE replace(p_name, 'large', 'small') END ELSE p_name END AS new_name, r <= 20 AS updated
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part)""")
def trade_update_toggle(spark, d):
    """At most 20 parts of each brand get their name toggled."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    capped = part.withColumn("updated", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) <= 20)
    return capped.select("p_partkey", F.when(F.col("updated"), toggle(F.col("p_name"), "small", "large")).otherwise(F.col("p_name")).alias("new_name"), "updated")


@query("""SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey < 3 UNION ALL SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (2, 5)""")
def union_all_brokers(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return s.filter("s_suppkey < 3").unionByName(s.filter(F.col("s_suppkey").isin(2, 5)))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand || ' ' || p_type END AS shown FROM part""")
def flagged_projection(spark, d):
    return table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.concat_ws(" ", "p_brand", "p_type")).alias("shown"))


@query("""SELECT o_orderkey, o_orderstatus, kind FROM (SELECT *, ['TSL','TLS','TLB'][o_orderkey % 3 + 1] AS kind, o_orderkey % 1000 + 900 AS bid, o_custkey % 1000 + 900 AS price FROM orders) WHERE (kind = 'TSL' AND price <= bid) OR (kind = 'TLS' AND price >= bid) OR (kind = 'TLB' AND price <= bid)""")
def price_trigger(spark, d):
    """Pending orders that the current price triggers: stop loss, limit sell, limit buy."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.element_at(F.array(F.lit("TSL"), F.lit("TLS"), F.lit("TLB")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("kind"), (F.col("o_orderkey") % 1000 + 900).alias("bid"), (F.col("o_custkey") % 1000 + 900).alias("price"))
    up = (F.col("kind") == "TLS") & (F.col("price") >= F.col("bid"))
    return rows.filter(up | (F.col("kind").isin("TSL", "TLB") & (F.col("price") <= F.col("bid")))).select("o_orderkey", "o_orderstatus", "kind")


@query("""SELECT o_orderkey, o_custkey, cost_cents, round(profit, 4) AS profit, CASE WHEN profit > 0 THEN CAST(round(profit * 0.2 * 100) AS BIGINT) ELSE 0 END AS tax_cents FROM (SELECT o_orderkey, o_custkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS cost_cents,
sum(CAST(round(l_quantity * p_retailprice * 100) AS BIGINT) - CAST(round(l_extendedprice * 100) AS BIGINT))::DOUBLE / 100 AS profit FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL)""")
def trade_order_estimate(spark, d):
    """What closing each order at the current price would earn, and the tax on a gain."""
    prices = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    rows = trades(spark, d, "l_partkey", "l_quantity", "l_extendedprice").join(prices, "l_partkey")
    gain = F.sum(F.round(F.col("l_quantity") * F.col("p_retailprice") * 100).cast("long") - cents(F.col("l_extendedprice"))).cast("double") / 100
    out = rows.groupBy(F.col("l_orderkey").alias("o_orderkey"), "o_custkey").agg(F.sum(cents(F.col("l_extendedprice"))).alias("cost_cents"), gain.alias("p"))
    return out.select("o_orderkey", "o_custkey", "cost_cents", F.round("p", 4).alias("profit"), F.when(F.col("p") > 0, F.round(F.col("p") * 0.2 * 100).cast("long")).otherwise(0).alias("tax_cents"))
