"""Tables that are made, written and read back; loaders; key generators; run metrics; scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark.operators import access, loading, versions
from tidemark.plans.registry import query
from tidemark.sources import table
from tidemark.sources.catalog import Catalog
from tidemark.sources.scratch import new_path, saved


@query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS balance, CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END::BIGINT AS commit_ts FROM customer WHERE c_mktsegment <> 'MACHINERY'
UNION ALL SELECT -1, 7.0, 4""")
def table_lifecycle(spark, d):
    """Create, insert, update, delete, a commit that loses and is dropped, and a retry that wins; what is left, with the stamp of its version."""
    t = versions.VersionedTable(new_path(spark, "lifecycle"), ["c_custkey"]).create(spark, "c_custkey long, balance double, segment string")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    steps = [customers.withColumn("op", F.lit("I")), customers.filter("balance < 0").withColumn("balance", F.lit(0.0)).withColumn("op", F.lit("U")), customers.filter("segment = 'MACHINERY'").withColumn("op", F.lit("D"))]
    for ts, staged in enumerate(steps):
        if t.commit(spark, staged, ts) is not versions.Result.OK:
            raise ValueError(f"step {ts} was refused")
    mine = spark.createDataFrame([(-1, 7.0, "NEW", "I")], "c_custkey long, balance double, segment string, op string")
    stale = customers.filter("balance < 0").withColumn("op", F.lit("U"))
    if t.commit(spark, stale, 1) is versions.Result.OK:
        raise ValueError("a stale update was let through")
    versions.with_retry(lambda _: t.commit(spark, mine, t.watermark(spark)))
    return t.at(spark).select("c_custkey", "balance", "commit_ts")


@query("""SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0 AND c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal + 100 FROM customer WHERE c_acctbal >= 0 AND c_custkey % 2 = 1""")
def recover_from_checkpoint(spark, d):
    """A checkpoint, changes after it, and the state that recovery puts together: odd keys gain 100, keys in debt go."""
    t = versions.VersionedTable(new_path(spark, "recovery"), ["c_custkey"]).create(spark, "c_custkey long, balance double")
    customers = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    t.commit(spark, customers.withColumn("op", F.lit("I")), 0)
    snapshots = new_path(spark, "snapshots")
    t.checkpoint(spark, snapshots, 1)
    t.commit(spark, customers.filter("c_custkey % 2 = 1").withColumn("balance", F.col("balance") + 100).withColumn("op", F.lit("U")), 1)
    t.commit(spark, customers.filter("balance < 0").select("c_custkey", F.lit(None).cast("double").alias("balance"), F.lit("D").alias("op")), 2)
    return t.recover(spark, snapshots).select("c_custkey", "balance")


@query("SELECT o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders")
def bulk_load(spark, d):
    """Orders loaded in batches, read back and held against what was to be loaded."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", fn.cents(F.col("o_totalprice")).alias("cents"))
    t = versions.VersionedTable(new_path(spark, "loaded"), ["o_orderkey"]).create(spark, "o_orderkey long, o_custkey long, cents long")
    loading.bulk_load(spark, t, rows, batches=3)
    return t.at(spark).drop("op", "commit_ts")


def _lcg(salt: int) -> str:
    step = "(({0} * 1103515245 + 12345) % 2147483648)"
    return f"(({step.format(step.format(f'((o_orderkey + {salt * 7919}) % 2147483648)'))} >> 8) % 1048576)::DOUBLE / 1048576.0"


@query(f"""WITH r AS (SELECT {_lcg(1)} AS u, {_lcg(2)} AS v FROM orders), z AS (SELECT sum(k ** -0.99) AS zeta FROM range(1, 101) t(k)),
k AS (SELECT 'uniform' AS kind, floor(u * 100)::BIGINT + 1 AS key FROM r
UNION ALL SELECT 'hot', CASE WHEN u < 0.8 THEN floor(v * 20)::BIGINT + 1 ELSE floor(v * 80)::BIGINT + 21 END FROM r
UNION ALL SELECT 'nurand', ((floor(u * 64)::BIGINT | (floor(v * 100)::BIGINT + 1)) + 7) % 100 + 1 FROM r
UNION ALL SELECT 'zipf', CASE WHEN u * zeta < 1 THEN 1 WHEN u * zeta < 1 + 0.5 ** 0.99 THEN 2 ELSE least(100, floor(100 * ((e * u - e + 1.0) ** (1 / (1 - 0.99)))) + 1) END::BIGINT FROM (SELECT u, zeta, (1 - (2 / 100) ** (1 - 0.99)) / (1 - (1 + 0.5 ** 0.99) / zeta) AS e FROM r, z))
SELECT kind, key, count(*) AS n FROM k GROUP BY ALL""")
def key_generators(spark, d):
    """How often each key of [1, 100] is drawn, one draw of each kind for every order."""
    u, v = (fn.random(F.col("o_orderkey"), salt) for salt in (1, 2))
    drawn = table(spark, d, "orders").select(u.alias("u"), v.alias("v"))
    kinds = {"uniform": fn.uniform(F.col("u"), 1, 100), "hot": fn.hot(F.col("u"), F.col("v"), 1, 100), "nurand": fn.nurand(F.col("u"), F.col("v"), 63, 7, 1, 100), "zipf": fn.zipf(F.col("u"), 100)}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), x.alias("key")) for k, x in kinds.items()]))
    return drawn.select(each.alias("x")).groupBy("x.kind", "x.key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT user_id % 8 AS worker, count(*) FILTER (WHERE event_type <> 'error') AS commits, count(*) FILTER (WHERE event_type = 'error') AS aborts,
round(count(*) FILTER (WHERE event_type <> 'error') / (epoch(max(ts)) - epoch(min(ts))), 9) AS rate, round(avg(value), 6) AS latency FROM events GROUP BY ALL""")
def totals_by_worker(spark, d):
    """Commits, aborts, commits a second and mean latency; users are dealt to eight workers, errors are aborts."""
    return loading.totals(_runs(spark, d), "worker")


@query("""SELECT floor(epoch(ts) - (SELECT epoch(min(ts)) FROM events))::BIGINT // 3600 AS sec, count(*) FILTER (WHERE event_type <> 'error') AS commits, count(*) FILTER (WHERE event_type = 'error') AS aborts FROM events GROUP BY ALL""")
def counters_by_time(spark, d):
    """The series of a run, by hour here, written as counters and read back."""
    path = new_path(spark, "counters")
    return loading.counters(_runs(spark, d), path, every=3600)


def _runs(spark, d):
    failed = F.col("event_type") == "error"
    return table(spark, d, "events").select((F.col("user_id") % 8).alias("worker"), "ts", failed.alias("failed"), F.col("value").alias("latency"))


@query("""SELECT c_custkey, starts_with(c_mktsegment, 'BU') AS is_bu, hex(encode(c_name[1:4])) AS head, hex(encode(c_name[9:])) AS tail, c_name < 'Customer#000000100' AS below FROM customer""")
def scalar_bytes(spark, d):
    """Prefix comparison, and prefix, shift, hexadecimal form and order of bytes."""
    raw = F.col("c_name").cast("binary")
    return table(spark, d, "customer").select("c_custkey", F.startswith("c_mktsegment", F.lit("BU")).alias("is_bu"), F.hex(fn.prefix(raw, 4)).alias("head"), F.hex(fn.shifted(raw, 8)).alias("tail"), (raw < F.lit(b"Customer#000000100")).alias("below"))


@query("""SELECT event_id, epoch_us(ts) AS number, strftime(make_timestamp(epoch_us(ts)) + INTERVAL 2 DAY, '%Y-%m-%d') AS due FROM events""")
def scalar_times(spark, d):
    """A time as a whole number and back, and the day two days later."""
    n = fn.number_of(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", n.alias("number"), F.date_format(F.date_add(fn.time_of(n), 2), "yyyy-MM-dd").alias("due"))


@query("""SELECT s_suppkey, l_partkey, step, CASE WHEN step % 5 = 0 THEN qty + 1 ELSE qty END AS qty FROM (SELECT s_suppkey, l_partkey, qty, (r - start + n) % n AS step FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY l_partkey) - 1 AS r, count(*) OVER (PARTITION BY s_suppkey) AS n, (s_suppkey * 37) % count(*) OVER (PARTITION BY s_suppkey) AS start
FROM (SELECT l_suppkey AS s_suppkey, l_partkey, sum(l_quantity)::BIGINT AS qty FROM lineitem GROUP BY ALL))) WHERE step < 10""")
def micro_wraparound(spark, d):
    """Ten stock rows of each supplier in key order from some place on, the first ones after the last, of which every fifth is written."""
    stock = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").agg(F.sum("l_quantity").cast("long").alias("qty"))
    rows = loading.wraparound(stock, ["s_suppkey"], ["l_partkey"], F.col("s_suppkey") * 37, 10)
    return rows.withColumn("qty", F.col("qty") + F.when(F.col("step") % 5 == 0, 1).otherwise(0)).select("s_suppkey", "l_partkey", "step", "qty")


@query("""SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderpriority = '1-URGENT' THEN 100 ELSE 0 END AS cents, CASE WHEN o_orderpriority = '1-URGENT' THEN 2 ELSE 1 END::BIGINT AS commit_ts FROM orders""")
def read_modify_write_log(spark, d):
    """Read, change and write back: the new versions of urgent orders are appended and win."""
    t = versions.VersionedTable(new_path(spark, "rmw"), ["o_orderkey"]).create(spark, "o_orderkey long, cents long, priority string")
    rows = table(spark, d, "orders").select("o_orderkey", fn.cents(F.col("o_totalprice")).alias("cents"), F.col("o_orderpriority").alias("priority"))
    t.commit(spark, rows.withColumn("op", F.lit("I")), 0)
    txn = t.begin(spark)
    txn.write(saved(txn.read().filter("priority = '1-URGENT'").withColumn("cents", F.col("cents") + 100), "changed"), "U")
    txn.commit()
    return t.at(spark).select("o_orderkey", "cents", "commit_ts")


def _catalog(spark, d):
    c = Catalog(new_path(spark, "catalog")).create(spark)
    t = c.create_table(spark, "orders", "o_orderkey long, o_custkey long, cents long", ["o_orderkey"])
    c.create_index(spark, "by_customer", "orders", ["o_custkey", "o_orderkey"])
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", fn.cents(F.col("o_totalprice")).alias("cents"))
    t.commit(spark, rows.withColumn("op", F.lit("I")), 0)
    return c


@query("""SELECT * FROM (VALUES ('orders', 'table', NULL, 'o_orderkey'), ('orders.primary', 'primary', 'orders', 'o_orderkey'), ('by_customer', 'secondary', 'orders', 'o_custkey,o_orderkey')) t(name, kind, "of", columns)""")
def catalog_entries(spark, d):
    """What is defined: a table, its primary index and a secondary one."""
    return _catalog(spark, d).entries().at(spark).select("name", "kind", "of", "columns")


@query("""SELECT o_custkey, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders WHERE (o_custkey > 10 OR (o_custkey = 10 AND o_orderkey >= 50)) AND o_custkey < 20""")
def index_range(spark, d):
    """A range of a secondary index, read from its sorted copy."""
    copy = _catalog(spark, d).build(spark, "by_customer")
    return access.scan(copy, ["o_custkey", "o_orderkey"], [10, 50], [20, -1]).select("o_custkey", "o_orderkey", "cents")


@query("""WITH b AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS place FROM customer WHERE c_mktsegment = 'BUILDING'), n AS (SELECT max(o_orderkey) AS top FROM orders), s AS (SELECT count(*) AS parts FROM part),
l AS (SELECT c_custkey, place, k, (c_custkey * 7 + k * 131) % parts AS p_partkey, c_custkey % 10 + k AS qty FROM b, s, range(1, 6) t(k)), bad AS (SELECT DISTINCT c_custkey FROM l JOIN part USING (p_partkey) WHERE p_brand = 'Brand#1')
SELECT top + dense_rank() OVER (ORDER BY place) AS o_orderkey, c_custkey, k AS line, p_partkey, qty, CAST(round(qty * p_retailprice * 100) AS BIGINT) AS amount_cents
FROM l JOIN part USING (p_partkey), n WHERE c_custkey NOT IN (SELECT c_custkey FROM bad)""")
def new_order_insert(spark, d):
    """New orders of five lines: an order with a wrong item (here a brand) is rolled back as a whole, the rest get the next numbers in turn, and priced lines."""
    customers, part = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey"), table(spark, d, "part")
    n_parts = part.count()
    lines = customers.select("c_custkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("line")).withColumn("p_partkey", (F.col("c_custkey") * 7 + F.col("line") * 131) % n_parts)
    lines = lines.join(part.select("p_partkey", "p_brand", "p_retailprice"), "p_partkey")
    bad = lines.filter("p_brand = 'Brand#1'").select("c_custkey").distinct()
    orders = access.ranked(customers.join(bad, "c_custkey", "left_anti"), [F.col("c_custkey").asc()])
    top = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    qty = F.col("c_custkey") % 10 + F.col("line")
    return lines.join(orders, "c_custkey").select((F.col("pos") + top).alias("o_orderkey"), "c_custkey", "line", "p_partkey", qty.alias("qty"), fn.cents(qty * F.col("p_retailprice")).alias("amount_cents"))
