"""Streaming queries, run to the end of what is there and compared with the batch answer."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.sources import table
from tidemark.sources.scratch import new_path
from tidemark.streaming import feeds


def _grouped(stream):
    """The groups of a finite stream in their last state, through a named in-memory sink; only for few groups, as of days and kinds."""
    spark, name = stream.sparkSession, f"grouped_{uuid.uuid4().hex}"
    stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


def _events(spark, d):
    return feeds.stream(spark, d, "events.parquet")


@query("SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL")
def stream_daily(spark, d):
    rows = _events(spark, d).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return _grouped(rows)


@query("SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, d):
    rows = feeds.windowed(_events(spark, d), "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")
    return _grouped(rows)


@query("SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL")
def batch_sliding(spark, d):
    return feeds.windowed(table(spark, d, "events"), "12 hours", "6 hours").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("""SELECT user_id, count(*) AS n, min(event_id) AS first_event FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""")
def batch_sessions(spark, d):
    rows = table(spark, d, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))
    return rows.select("user_id", "n", "first_event")


PENDING = "o_orderstatus = 'O'"
TICKS = "(SELECT event_id, user_id, value, o_orderkey FROM events e JOIN orders o ON o.o_custkey = e.user_id AND o.o_orderstatus = 'O' WHERE e.event_type = 'purchase' AND ((o.o_orderkey % 3 = 0 AND e.value >= o.o_orderkey % 40) OR (o.o_orderkey % 3 <> 0 AND e.value <= o.o_orderkey % 40)))"


def _feed(spark, d):
    """A stream of prices (purchases, by user) and pending requests (open orders, by customer)."""
    ticks = _events(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("seq"), F.col("user_id").alias("symbol"), F.col("value").alias("price"))
    key = F.col("o_orderkey")
    requests = table(spark, d, "orders").filter(PENDING).select(key.alias("request"), F.col("o_custkey").alias("symbol"), F.when(key % 3 == 0, "TLS").when(key % 3 == 1, "TLB").otherwise("TSL").alias("kind"), (key % 40).cast("double").alias("bid_price"))
    return ticks, requests


@query(f"SELECT event_id, o_orderkey FROM {TICKS}")
def market_feed(spark, d):
    """Each tick with all requests that its price triggers."""
    hits = feeds.market_feed(*_feed(spark, d)).select(F.col("seq").alias("event_id"), F.col("request").alias("o_orderkey"))
    return feeds.drained(hits, new_path(spark, "market-feed"))


@query(f"SELECT o_orderkey, min(event_id) AS event_id, arg_min(value, event_id) AS price FROM {TICKS} GROUP BY o_orderkey")
def market_feed_submitted(spark, d):
    """The requests that the feed submits, each with the tick that triggers it first."""
    to = new_path(spark, "market-effects")
    feeds.apply_ticks(*_feed(spark, d), to, f"{to}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{to}/submitted").select(F.col("request").alias("o_orderkey"), F.col("seq").alias("event_id"), "price")


@query("SELECT user_id AS symbol, arg_max(value, event_id) AS price, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id")
def market_feed_prices(spark, d):
    """The last price of each symbol after the feed."""
    to = new_path(spark, "market-effects")
    feeds.apply_ticks(*_feed(spark, d), to, f"{to}/checkpoint").awaitTermination()
    prices = spark.read.parquet(f"{to}/prices").groupBy("symbol").agg(F.max_by("price", "seq").alias("price"), F.max("seq").alias("event_id"))
    return prices


@query("""SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM
(SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WHERE event_type = 'purchase')) GROUP BY user_id, s""")
def stream_sessions(spark, d):
    """Sessions of purchases as a stream."""
    rows = feeds.sessions(_events(spark, d).filter("event_type = 'purchase'"), "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")
    return _grouped(rows)
