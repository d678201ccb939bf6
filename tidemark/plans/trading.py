"""The brokerage workload's transactions and lookups in full. Stand-ins as in broker.py; a trade's own price is l_extendedprice, the exchange is the supplier's nation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import cents, last_name, toggle
from tidemark.operators import access, bands, lots
from tidemark.plans.broker import BANDS, BANDS_SQL, ORDER, TRADE_SQL, day, trades
from tidemark.plans.orders import stock
from tidemark.plans.registry import query
from tidemark.sources import table

C = "CAST(round({0} * 100) AS BIGINT)".format


@query(f"""SELECT b.n_name AS buyer, s.n_name AS seller, r_name, count(*) AS n, sum({C('l_extendedprice')})::BIGINT AS cents FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey
JOIN nation b ON b.n_nationkey = c_nationkey JOIN nation s ON s.n_nationkey = s_nationkey JOIN region ON r_regionkey = s.n_regionkey GROUP BY ALL""")
def trade_flows(spark, d):
    """A star join in which one table plays two roles: the nations of buyer and seller."""
    nation = table(spark, d, "nation")
    role = lambda key, name: nation.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(name), *([F.col("n_regionkey").alias("r_regionkey")] if name == "seller" else []))
    rows = trades(spark, d, "l_suppkey", "l_extendedprice").withColumn("c", cents(F.col("l_extendedprice")))
    buyers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    sellers = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    by = rows.join(buyers, "o_custkey").join(sellers, "l_suppkey").groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("cents"))
    return by.join(role("c_nationkey", "buyer"), "c_nationkey").join(role("s_nationkey", "seller"), "s_nationkey").join(table(spark, d, "region"), "r_regionkey").select("buyer", "seller", "r_name", "n", "cents")


DAILY = f"(SELECT l_partkey, l_shipdate, max({C('l_extendedprice')}) AS high, min({C('l_extendedprice')}) AS low, count(*) AS n FROM lineitem GROUP BY ALL)"


def _daily(spark, d):
    c = cents(F.col("l_extendedprice"))
    return table(spark, d, "lineitem").groupBy("l_partkey", "l_shipdate").agg(F.max(c).alias("high"), F.min(c).alias("low"), F.count(F.lit(1)).alias("n"))


@query(f"SELECT p_partkey, strftime(o.day, '%Y-%m-%d') AS day, high, low FROM (SELECT p_partkey, TIMESTAMP '2000-01-01' + INTERVAL 1 DAY * (p_partkey % 365) AS day FROM part) o LEFT JOIN {DAILY} x ON x.l_partkey = p_partkey AND x.l_shipdate = o.day")
def price_on_date(spark, d):
    """The price of a symbol on exactly one day, if there is one."""
    asked = table(spark, d, "part").select("p_partkey", F.expr("timestamp_ntz '2000-01-01' + make_dt_interval(cast(p_partkey % 365 as int))").alias("on"))
    prices = _daily(spark, d).select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").cast("timestamp_ntz").alias("on"), "high", "low")
    return asked.join(prices, ["p_partkey", "on"], "left").select("p_partkey", day("on").alias("day"), "high", "low")


@query(f"SELECT o_orderkey, n_lines, cash_cents FROM (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT o_orderkey AS k, {C('o_totalprice')} AS cash_cents, o_orderstatus AS st FROM orders) ON k = o_orderkey AND st = 'F'")
def trade_cash(spark, d):
    """Trades with their cash movement where they are settled in cash: a lookup that depends on a flag."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    orders = table(spark, d, "orders")
    cash = orders.filter("o_orderstatus = 'F'").select("o_orderkey", cents(F.col("o_totalprice")).alias("cash_cents"))
    return lines.join(orders.select("o_orderkey"), "o_orderkey").join(cash, "o_orderkey", "left").select("o_orderkey", "n_lines", "cash_cents")


@query("""SELECT p_partkey, coalesce((SELECT string_agg(q.p_partkey::VARCHAR, ',' ORDER BY q.p_partkey) FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS r FROM part) q WHERE q.p_type = p.p_type AND q.p_brand = p.p_brand AND q.p_partkey <> p.p_partkey AND q.r <= 4 AND q.r <= 3 + (p.r <= 3)::INT), '') AS competitors,
coalesce(fin, '') AS financials, coalesce(dly, '') AS daily, coalesce(news, '') AS news FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS r FROM part) p
LEFT JOIN (SELECT l_partkey, string_agg(y || '=' || c, ',' ORDER BY y DESC) AS fin FROM (SELECT l_partkey, year(l_shipdate) * 10 + quarter(l_shipdate) AS y, sum(CAST(round(l_extendedprice * 100) AS BIGINT))::BIGINT AS c, row_number() OVER (PARTITION BY l_partkey ORDER BY year(l_shipdate) * 10 + quarter(l_shipdate) DESC) AS r FROM lineitem GROUP BY l_partkey, year(l_shipdate) * 10 + quarter(l_shipdate)) WHERE r <= 20 GROUP BY l_partkey) f ON f.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, string_agg(strftime(l_shipdate, '%Y-%m-%d') || '=' || high, ',' ORDER BY l_shipdate) AS dly FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate) AS r FROM """ + DAILY + """ WHERE l_shipdate >= TIMESTAMP '1997-01-01') WHERE r <= 20 GROUP BY l_partkey) y ON y.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, string_agg(l_orderkey::VARCHAR, ',' ORDER BY l_orderkey DESC) AS news FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC) AS r FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem)) WHERE r <= 2 GROUP BY l_partkey) n ON n.l_partkey = p_partkey""")
def security_detail_lists(spark, d):
    """Of each security: three competitors, twenty quarters, twenty days from a date on, and the two newest orders, as lists."""
    part, lines = table(spark, d, "part").select("p_partkey", "p_type", "p_brand"), table(spark, d, "lineitem")
    listed = lambda rows, n, key, order, text, name, down: access.first_per(rows, [key], [order], n, last=down).groupBy(F.col(key).alias("p_partkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t"))), asc=not down), lambda x: x["t"]), ",").alias(name))
    first = access.first_per(part, ["p_type", "p_brand"], ["p_partkey"], 4).groupBy("p_type", "p_brand").agg(F.sort_array(F.collect_list("p_partkey")).alias("firsts"))
    others = F.slice(F.filter("firsts", lambda x: x != F.col("p_partkey")), 1, 3)
    out = part.join(first, ["p_type", "p_brand"]).select("p_partkey", F.array_join(others.cast("array<string>"), ",").alias("competitors"))
    quarter = (F.year("l_shipdate") * 10 + F.quarter("l_shipdate")).alias("q")
    financials = lines.groupBy("l_partkey", quarter).agg(F.sum(cents(F.col("l_extendedprice"))).alias("c"))
    days = _daily(spark, d).filter("l_shipdate >= timestamp '1997-01-01'")
    news = lines.select("l_partkey", "l_orderkey").distinct()
    for rows, n, order, text, name, down in ((financials, 20, "q", F.concat_ws("=", "q", "c"), "financials", True), (days, 20, "l_shipdate", F.concat_ws("=", day("l_shipdate"), "high"), "daily", False), (news, 2, "l_orderkey", F.col("l_orderkey").cast("string"), "news", True)):
        out = out.join(listed(rows, n, "l_partkey", order, text, name, down), "p_partkey", "left")
    return out.select("p_partkey", "competitors", *[F.coalesce(c, F.lit("")).alias(c) for c in ("financials", "daily", "news")])


SETTLED = f"(SELECT l.*, o_custkey, o_orderpriority, c_nationkey, s_nationkey, p_retailprice, rate FROM lineitem l JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey JOIN {BANDS_SQL} ON l_quantity BETWEEN from_qty AND to_qty)"


def _priced(spark, d):
    """Trades with account, nations of both sides, last price and commission rate."""
    rates = spark.createDataFrame(BANDS, "from_qty int, to_qty int, rate double")
    owners = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    rows = table(spark, d, "lineitem").join(owners, "l_orderkey").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice"), "l_partkey")
    return bands.band_join(rows, rates, "l_quantity", "from_qty", "to_qty", 10)


@query(f"""SELECT l_orderkey, count(*) AS n, max(CASE WHEN c_nationkey = s_nationkey THEN 'PNDG' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'SBMT' ELSE 'ROLLBACK' END) AS status, sum({C('l_quantity * p_retailprice')})::BIGINT AS asked_cents,
sum({C('l_quantity * p_retailprice * rate')})::BIGINT AS commission_cents, sum({C('l_quantity * p_retailprice * l_tax')})::BIGINT AS tax_cents, (count(*) * CASE WHEN o_orderpriority = '1-URGENT' THEN 500 ELSE 100 END)::BIGINT AS charge_cents FROM {SETTLED}
WHERE c_nationkey = s_nationkey OR o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY l_orderkey, o_orderpriority""")
def trade_order_insert(spark, d):
    """Orders as they are entered: whoever trades abroad needs permission (here a high priority), else the order is rolled back; the rest
    gets its price, commission, tax and charge, and waits (at home) or is submitted."""
    home = F.col("c_nationkey") == F.col("s_nationkey")
    allowed = home | F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    worth = F.col("l_quantity") * F.col("p_retailprice")
    rows = _priced(spark, d).filter(allowed).withColumn("status", F.when(home, "PNDG").otherwise("SBMT"))
    charge = F.count(F.lit(1)) * F.when(F.col("o_orderpriority") == "1-URGENT", 500).otherwise(100)
    return rows.groupBy("l_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status"), F.sum(cents(worth)).alias("asked_cents"), F.sum(cents(worth * F.col("rate"))).alias("commission_cents"), F.sum(cents(worth * F.col("l_tax"))).alias("tax_cents"), charge.alias("charge_cents")).drop("o_orderpriority")


@query(f"SELECT l_orderkey, l_linenumber, count(*) AS n FROM {SETTLED} WHERE c_nationkey <> s_nationkey AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY ALL")
def trade_order_rollback(spark, d):
    """The lines of orders that are rolled back for want of permission."""
    rows = _priced(spark, d).filter((F.col("c_nationkey") != F.col("s_nationkey")) & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


HELD = f"""(SELECT o_custkey, l_partkey, l_linestatus, sum(l_quantity) OVER w AS e, l_quantity, row_number() OVER w AS r FROM {TRADE_SQL} WINDOW w AS (PARTITION BY o_custkey, l_partkey, l_linestatus ORDER BY {", ".join(c for c in ORDER if c != 'l_linestatus')} ROWS UNBOUNDED PRECEDING))"""


@query(f"""WITH x AS {HELD}, b AS (SELECT * FROM x WHERE l_linestatus = 'O'), s AS (SELECT o_custkey, l_partkey, max(e) AS sold FROM x WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT o_custkey, l_partkey, r AS lot, l_quantity::BIGINT AS bought, greatest(0, least(l_quantity, e - coalesce(sold, 0)))::BIGINT AS left_qty FROM b LEFT JOIN s USING (o_custkey, l_partkey) WHERE greatest(0, least(l_quantity, e - coalesce(sold, 0))) > 0""")
def trade_result_holdings(spark, d):
    """Holdings after all sells (status F) have taken from the lots (status O), oldest first: sold-out lots go, a split one is written back."""
    order = [c for c in ORDER if c != "l_linestatus"]
    rows = trades(spark, d, "l_partkey", "l_linestatus", *[c for c in order if c != "l_orderkey"])
    sold = rows.filter("l_linestatus = 'F'").groupBy("o_custkey", "l_partkey").agg(F.sum("l_quantity").alias("sold"))
    bought = rows.filter("l_linestatus = 'O'").join(sold, ["o_custkey", "l_partkey"], "left")
    after = lots.consume(bought, ["o_custkey", "l_partkey"], order, "l_quantity", F.coalesce("sold", F.lit(0.0)))
    lot = F.row_number().over(Window.partitionBy("o_custkey", "l_partkey").orderBy(*order))
    return after.withColumn("lot", lot).filter("after_qty > 0").select("o_custkey", "l_partkey", "lot", F.col("l_quantity").cast("long").alias("bought"), F.col("after_qty").cast("long").alias("left_qty"))


@query(f"SELECT l_suppkey, count(*) AS n_trades, sum({C('l_extendedprice * rate')})::BIGINT AS commission_cents FROM {SETTLED} WHERE l_linestatus = 'F' GROUP BY l_suppkey")
def trade_result_brokers(spark, d):
    """What settled trades add to their brokers: the number of trades and the commission."""
    rows = _priced(spark, d).filter("l_linestatus = 'F'")
    return rows.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n_trades"), F.sum(cents(F.col("l_extendedprice") * F.col("rate"))).alias("commission_cents"))


@query("""SELECT o_orderkey, o_custkey, c_name, n_name, r_name, st_name, pr_name, r FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
JOIN (VALUES ('F', 'Completed'), ('O', 'Submitted'), ('P', 'Pending')) s(st, st_name) ON st = o_orderstatus JOIN (VALUES ('1-URGENT', 'Market'), ('2-HIGH', 'Market'), ('3-MEDIUM', 'Limit'), ('4-NOT SPECIFIED', 'Limit'), ('5-LOW', 'Stop')) t(pr, pr_name) ON pr = o_orderpriority WHERE r <= 50""")
def trade_status_names(spark, d):
    """The last fifty trades of each account with four lookups: owner, place, status and type."""
    recent = access.first_per(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 50, last=True, rank="r")
    states = spark.createDataFrame([("F", "Completed"), ("O", "Submitted"), ("P", "Pending")], "o_orderstatus string, st_name string")
    kinds = spark.createDataFrame([("1-URGENT", "Market"), ("2-HIGH", "Market"), ("3-MEDIUM", "Limit"), ("4-NOT SPECIFIED", "Limit"), ("5-LOW", "Stop")], "o_orderpriority string, pr_name string")
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    who = table(spark, d, "customer").join(places, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_name", "n_name", "r_name")
    return recent.join(who, "o_custkey").join(states, "o_orderstatus").join(kinds, "o_orderpriority").select("o_orderkey", "o_custkey", "c_name", "n_name", "r_name", "st_name", "pr_name", "r")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN r <= 20 THEN CASE WHEN o_orderstatus = 'F' THEN CASE WHEN contains(o_orderpriority, 'Cash') THEN replace(o_orderpriority, 'Cash', 'Margin') ELSE o_orderpriority || ' Cash' END ELSE o_orderpriority || ' Margin' END ELSE o_orderpriority END AS settled, r <= 20 AS updated
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1999-01-01')""")
def trade_update_settlement(spark, d):
    """By account and dates: the first twenty trades of each account get a new kind of settlement."""
    rows = table(spark, d, "orders").filter("o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1999-01-01'")
    first = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")) <= 20
    kind = F.col("o_orderpriority")
    cash = F.when(F.instr(kind, "Cash") > 0, F.replace(kind, F.lit("Cash"), F.lit("Margin"))).otherwise(F.concat(kind, F.lit(" Cash")))
    new = F.when(~F.col("updated"), kind).when(F.col("o_orderstatus") == "F", cash).otherwise(F.concat(kind, F.lit(" Margin")))
    return rows.withColumn("updated", first).select("o_orderkey", "o_custkey", new.alias("settled"), "updated")


@query(f"""SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, replace(l_quantity::BIGINT || CASE WHEN l_orderkey % 2 = 0 THEN ' shares of ' ELSE ' Shares of ' END || p_name, CASE WHEN l_orderkey % 2 = 0 THEN 'shares of' ELSE 'Shares of' END, CASE WHEN l_orderkey % 2 = 0 THEN 'Shares of' ELSE 'shares of' END) AS cash_name, r
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {", ".join(ORDER)}) AS r FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01') JOIN part ON p_partkey = l_partkey WHERE r <= 20""")
def trade_update_symbol(spark, d):
    """By symbol and date: the cash description of its first twenty trades is toggled between two spellings."""
    first = access.first_per(table(spark, d, "lineitem").filter("l_shipdate >= timestamp '1998-01-01'"), ["l_partkey"], ORDER, 20, rank="r")
    rows = first.join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    name = F.concat(F.col("l_quantity").cast("long"), F.when(F.col("l_orderkey") % 2 == 0, " shares of ").otherwise(" Shares of "), "p_name")
    return rows.select("l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", toggle(name, "shares of", "Shares of").alias("cash_name"), "r")


@query(f"""SELECT o_custkey, l_partkey, r, (e - l_quantity)::BIGINT AS before_qty, e::BIGINT AS after_qty FROM {HELD} WHERE l_linestatus = 'O'""")
def holding_changes(spark, d):
    """Quantity held before and after every buy of an account and symbol."""
    order = [c for c in ORDER if c != "l_linestatus"]
    w = Window.partitionBy("o_custkey", "l_partkey").orderBy(*order)
    rows = trades(spark, d, "l_partkey", "l_linestatus", *[c for c in order if c != "l_orderkey"]).filter("l_linestatus = 'O'")
    after = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("o_custkey", "l_partkey", F.row_number().over(w).alias("r"), (after - F.col("l_quantity")).cast("long").alias("before_qty"), after.cast("long").alias("after_qty"))


@query("""SELECT c_nationkey, count(DISTINCT (s.l_suppkey, s.l_partkey)) AS low_parts FROM (SELECT DISTINCT c_nationkey, l_suppkey, l_partkey FROM (SELECT o_orderkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey DESC) AS r FROM orders JOIN customer ON c_custkey = o_custkey) JOIN lineitem ON l_orderkey = o_orderkey WHERE r <= 20) x
JOIN (SELECT l_suppkey, l_partkey, sum(l_quantity) AS qty FROM lineitem GROUP BY ALL) s USING (l_suppkey, l_partkey) WHERE qty < 20 GROUP BY c_nationkey""")
def stock_level_by_district(spark, d):
    """Stock level over the last twenty orders of each district (nation)."""
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    last = access.first_per(table(spark, d, "orders").select("o_orderkey", "o_custkey").join(owners, "o_custkey"), ["c_nationkey"], ["o_orderkey"], 20, last=True)
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey")
    sold = last.select("c_nationkey", "o_orderkey").join(lines, "o_orderkey").select("c_nationkey", "l_suppkey", "l_partkey").distinct()
    return sold.join(stock(spark, d).filter("qty < 20"), ["l_suppkey", "l_partkey"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("low_parts"))


NAMES = "['BAR','OUGHT','ABLE','PRI','PRES','ESE','ANTI','CALLY','ATION','EING']"
NAMED = f"(SELECT *, {NAMES}[c_custkey // 100 % 10 + 1] || {NAMES}[c_custkey // 10 % 10 + 1] || {NAMES}[c_custkey % 10 + 1] AS last FROM customer)"


@query(f"""WITH c AS {NAMED}, m AS (SELECT c_nationkey, last, c_custkey AS by_name FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey, last ORDER BY c_name, c_custkey) AS r, count(*) OVER (PARTITION BY c_nationkey, last) AS n FROM c) WHERE r = (n + 1) // 2),
p AS (SELECT CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN o_custkey ELSE by_name END AS payer, {C('o_totalprice')} AS paid FROM orders JOIN c ON c_custkey = o_custkey JOIN m USING (c_nationkey, last) WHERE o_orderstatus = 'F')
SELECT payer AS c_custkey, count(*) AS n, sum(paid)::BIGINT AS paid, any_value({C('c_acctbal')}) - sum(paid)::BIGINT AS balance_cents FROM p JOIN customer ON c_custkey = payer GROUP BY payer""")
def payment_by_name(spark, d):
    """Payments of customers that give their number (low priorities) or their last name only: of those of one name the middle one pays."""
    customers = table(spark, d, "customer").withColumn("last", last_name(F.col("c_custkey")))
    middle = access.median_row(customers, ["c_nationkey", "last"], ["c_name", "c_custkey"]).select("c_nationkey", "last", F.col("c_custkey").alias("by_name"))
    who = customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "last").join(middle, ["c_nationkey", "last"])
    paid = table(spark, d, "orders").filter("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority", cents(F.col("o_totalprice")).alias("paid")).join(who, "o_custkey")
    payer = F.when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), F.col("o_custkey")).otherwise(F.col("by_name"))
    sums = paid.groupBy(payer.alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("paid").alias("paid"))
    return sums.join(table(spark, d, "customer").select("c_custkey", cents(F.col("c_acctbal")).alias("had")), "c_custkey").select("c_custkey", "n", "paid", (F.col("had") - F.col("paid")).alias("balance_cents"))


DUE = "(SELECT c_nationkey, min(o_orderkey) AS o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' GROUP BY c_nationkey)"


@query(f"""SELECT o.o_orderkey, o.o_custkey, CASE WHEN m.o_orderkey IS NULL THEN 'waiting' ELSE 'delivered' END AS state, CASE WHEN m.o_orderkey IS NOT NULL THEN m.c_nationkey % 10 + 1 END AS carrier, CASE WHEN m.o_orderkey IS NOT NULL THEN {C('c_acctbal')} + coalesce(amount, 0) END AS balance_cents
FROM orders o JOIN customer ON c_custkey = o_custkey LEFT JOIN {DUE} m ON m.o_orderkey = o.o_orderkey LEFT JOIN (SELECT l_orderkey, sum({C('l_extendedprice')})::BIGINT AS amount FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o.o_orderkey WHERE o_orderstatus = 'O'""")
def delivery(spark, d):
    """All open orders after one delivery in each district: the oldest gets a carrier and leaves the queue, its customer's balance grows by its lines."""
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", cents(F.col("c_acctbal")).alias("had"))
    waiting = table(spark, d, "orders").filter("o_orderstatus = 'O'").select("o_orderkey", "o_custkey").join(owners, "o_custkey")
    due = waiting.groupBy("c_nationkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", (F.col("c_nationkey") % 10 + 1).alias("carrier"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), cents(F.col("l_extendedprice")).alias("c"))
    amounts = lines.join(due, "o_orderkey").groupBy("o_orderkey", "carrier").agg(F.sum("c").alias("amount"))
    amounts = due.join(amounts.drop("carrier"), "o_orderkey", "left")
    done = F.col("carrier").isNotNull()
    return waiting.join(amounts, "o_orderkey", "left").select("o_orderkey", "o_custkey", F.when(done, "delivered").otherwise("waiting").alias("state"), "carrier", F.when(done, F.col("had") + F.coalesce("amount", F.lit(0))).alias("balance_cents"))
