"""Version-log and certification queries. events stand in for a log: user_id is the key, event_id the commit stamp."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bands, serial, versions
from tidemark.plans.registry import query
from tidemark.sources import table

CUT = 6000


def log(spark, d):
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "I").otherwise("U")
    return table(spark, d, "events").select("user_id", "value", F.col("event_id").alias("commit_ts"), op.alias("op"))


LOG = "(SELECT user_id, value, event_id AS commit_ts, CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op FROM events)"
NEWEST = f"(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY commit_ts DESC) AS r FROM {LOG})"


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE ts <= TIMESTAMP '2024-01-15') WHERE r = 1""")
def snapshot_latest(spark, d):
    rows = table(spark, d, "events").filter("ts <= timestamp '2024-01-15'").select("user_id", "event_id", "value", F.col("ts").alias("commit_ts"))
    return versions.latest(rows, ["user_id"], ["event_id"]).drop("commit_ts")


@query(f"SELECT user_id, value, commit_ts, op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY commit_ts DESC) AS r FROM {LOG} WHERE commit_ts <= {CUT}) WHERE r = 1 AND op <> 'D'")
def snapshot_at(spark, d):
    return versions.snapshot(log(spark, d), ["user_id"], CUT)


@query(f"SELECT user_id, commit_ts FROM {NEWEST} WHERE r = 1 AND op = 'D'")
def tombstones(spark, d):
    return versions.latest(log(spark, d), ["user_id"], deleted=True).filter("op = 'D'").select("user_id", "commit_ts")


@query(f"SELECT user_id, value, commit_ts, op FROM {LOG} WHERE commit_ts > {CUT} UNION ALL SELECT user_id, value, commit_ts, op FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY commit_ts DESC) AS r FROM {LOG} WHERE commit_ts <= {CUT}) WHERE r = 1")
def gc_keep_set(spark, d):
    return versions.gc_keep(log(spark, d), ["user_id"], CUT)


STAGED = f"(SELECT DISTINCT user_id FROM {LOG} WHERE user_id % 3 = 0)"


@query(f"SELECT user_id FROM {STAGED} WHERE user_id IN (SELECT user_id FROM {LOG} WHERE commit_ts > 9900)")
def first_updater_wins(spark, d):
    staged = log(spark, d).filter("user_id % 3 = 0").select("user_id").distinct()
    return versions.conflicts(log(spark, d), staged, ["user_id"], 9900)


@query(f"""SELECT user_id, CASE WHEN user_id % 7 = 0 THEN -1.0 ELSE value END AS value FROM {NEWEST} WHERE r = 1 AND (op <> 'D' OR user_id % 7 = 0)""")
def own_writes(spark, d):
    """Every seventh user is written twice by the reading transaction; the second write shows."""
    base = log(spark, d)
    keys = base.filter("user_id % 7 = 0").select("user_id").distinct()
    staged = keys.select("user_id", F.lit(-9.0).alias("value"), F.lit("U").alias("op"), F.lit(0).cast("long").alias("seq")).unionByName(keys.select("user_id", F.lit(-1.0).alias("value"), F.lit("U").alias("op"), F.lit(1).cast("long").alias("seq")))
    return versions.own_writes(base, staged, ["user_id"], 2**62).select("user_id", "value")


@query(f"""SELECT coalesce(a.user_id, b.user_id) AS user_id FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY commit_ts DESC) AS r FROM {LOG} WHERE commit_ts <= {CUT}) WHERE r = 1 AND op <> 'D' AND user_id < 40) a
FULL JOIN (SELECT * FROM {NEWEST} WHERE r = 1 AND op <> 'D' AND user_id < 40) b ON a.user_id = b.user_id WHERE a.commit_ts IS DISTINCT FROM b.commit_ts""")
def phantom_check(spark, d):
    return versions.phantoms(log(spark, d), ["user_id"], F.col("user_id") < 40, CUT, 2**62).select("user_id")


@query("""SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'""")
def as_of_purchase(spark, d):
    """Each error with its user's last purchase at or before it."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("p_ts"), F.col("event_id").alias("last_purchase"))
    return bands.as_of(left, right, ["user_id"], "ts", "p_ts", ["last_purchase"], cell=7 * 86400).select("event_id", "last_purchase")


def _history(spark, d):
    """A made-up history: each event is a transaction that overwrites its user's last version; purchases read the one before that."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type").withColumn("p1", F.lag("event_id", 1).over(w)).withColumn("p2", F.lag("event_id", 2).over(w))
    txns = e.select(F.col("event_id").alias("txn"), (F.col("event_id") * 10 - 3000).alias("begin_ts"), (F.col("event_id") * 10).alias("commit_ts"))
    writes = e.filter("p1 is not null").select(F.col("event_id").alias("txn"), F.col("user_id").alias("key"), F.col("p1").alias("version"))
    reads = e.filter("p2 is not null and event_type = 'purchase'").select(F.col("event_id").alias("txn"), F.col("user_id").alias("key"), F.col("p2").alias("version"))
    return txns, reads, writes


HISTORY = """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, lag(event_id, 1) OVER w AS p1, lag(event_id, 2) OVER w AS p2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS (SELECT event_id AS txn, event_id * 10 - 3000 AS begin_ts, event_id * 10 AS commit_ts FROM e), wr AS (SELECT event_id AS txn, user_id AS key, p1 AS version FROM e WHERE p1 IS NOT NULL),
rd AS (SELECT event_id AS txn, user_id AS key, p2 AS version FROM e WHERE p2 IS NOT NULL AND event_type = 'purchase'),
dep AS (SELECT version AS src, txn AS dst, 'wr' AS kind FROM rd UNION SELECT version, txn, 'ww' FROM wr UNION SELECT rd.txn, wr.txn, 'rw' FROM rd JOIN wr USING (key, version)) """


@query(HISTORY + """, back AS (SELECT src, dst FROM dep WHERE kind = 'rw' AND dst < src), reach AS (SELECT src, dst FROM back UNION SELECT r.src, b.dst FROM reach r JOIN back b ON b.src = r.dst)
SELECT txn, greatest(0, coalesce(eta, 0))::BIGINT AS eta, least(commit_ts, coalesce(pi, commit_ts))::BIGINT AS pi, least(commit_ts, coalesce(pi, commit_ts)) <= coalesce(eta, 0) AS abort FROM t
LEFT JOIN (SELECT dst, max(src * 10) AS eta FROM dep WHERE src <> dst AND src < dst GROUP BY dst) ON dst = txn LEFT JOIN (SELECT src, min(dst * 10) AS pi FROM reach GROUP BY src) ON src = txn""")
def ssn_certifier(spark, d):
    return serial.ssn(*_history(spark, d)).select("txn", "eta", "pi", "abort")


@query(HISTORY + """SELECT DISTINCT a.src AS t1, a.dst AS t2, b.dst AS t3 FROM dep a JOIN dep b ON a.dst = b.src WHERE a.kind = 'rw' AND b.kind = 'rw' AND a.src <> a.dst AND b.src <> b.dst
AND abs(a.src - a.dst) * 10 < 3000 AND abs(b.src - b.dst) * 10 < 3000 AND b.dst <= a.src AND b.dst < a.dst""")
def ssi_dangerous(spark, d):
    return serial.dangerous(*_history(spark, d))


@query(HISTORY + "SELECT DISTINCT rd.txn FROM rd JOIN wr USING (key, version) WHERE wr.txn < rd.txn")
def mvocc_stale_reads(spark, d):
    return serial.stale_reads(*_history(spark, d))
