"""Streams over folders of Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import versions
from tidemark.sources import complete


def stream(spark: SparkSession, path: str, pattern: str | None = None, files_per_batch: int = 1) -> DataFrame:
    """A file source with the schema of what is there now."""
    only = {"pathGlobFilter": pattern} if pattern else {}
    schema = spark.read.options(**only).parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.options(**only).parquet(path)


def replay(log: DataFrame, to: str, checkpoint: str, every: str | None = None):
    """Ship a change log to a replica: each micro-batch goes to its own folder, which a repeated batch overwrites.

    Without `every` the log is drained and the query ends; with it (as "10 seconds") the replica follows in the background at that pace.
    """

    def ship(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return log.writeStream.foreachBatch(ship).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_view(spark: SparkSession, replica: str, keys: list[str], batch: int | None = None) -> DataFrame:
    """The replica's table at the last batch whose write, and that of all before it, has ended; or at an earlier one."""
    done = complete(spark, replica, "batch")
    whole = [n for i, n in enumerate(done) if n == done[0] + i and (batch is None or n <= batch)]
    log = spark.read.option("basePath", replica).parquet(*[f"{replica}/batch={n}" for n in whole])
    return versions.latest(log, keys).drop("batch")


def redo(commands: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], to: str, checkpoint: str):
    """Replay a command log (kind, and what the commands of that kind need) by running the commands again, not by shipping what they wrote.

    A handler turns all commands of its kind in a batch into change rows, by the commands alone; a repeated batch so gives the same rows.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        out = None
        for kind, handler in handlers.items():
            rows = handler(batch.filter(F.col("kind") == kind))
            out = rows if out is None else out.unionByName(rows)
        out.write.mode("overwrite").parquet(f"{to}/batch={batch_id}")

    return commands.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, path: str) -> DataFrame:
    """The rows that a finite stream appends, as files below path; the sink's own log counts each batch once."""
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def apply_ticks(ticks: DataFrame, requests: DataFrame, to: str, checkpoint: str):
    """A market feed with its effects, batch by batch: ticks (symbol, price, seq) set last prices and submit pending requests (request, symbol, kind, bid_price).

    prices/ gets each batch's last price by symbol, submitted/ the requests that it triggers, each with the first tick that does so. A request
    submitted by an earlier batch is pending no more. A repeated batch overwrites what it wrote.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.groupBy("symbol").agg(F.max_by("price", "seq").alias("price"), F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{to}/prices/batch={batch_id}")
        before = [f"{to}/submitted/batch={n}" for n in complete(spark, f"{to}/submitted", "batch") if n < batch_id]
        pending = requests
        if before:
            pending = pending.join(spark.read.parquet(*before).select("request"), "request", "left_anti")
        hit = market_feed(batch, pending).groupBy("request").agg(F.min_by("price", "seq").alias("price"), F.min("seq").alias("seq"))
        hit.write.mode("overwrite").parquet(f"{to}/submitted/batch={batch_id}")

    return ticks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def market_feed(ticks: DataFrame, requests: DataFrame) -> DataFrame:
    """Ticks (symbol, price) against pending requests (symbol, kind, bid_price): those that the price triggers.

    TSL sells at or below, TLS sells at or above, TLB buys at or below the bid.
    """
    hit = ((F.col("kind") == "TSL") & (F.col("price") <= F.col("bid_price"))) | ((F.col("kind") == "TLS") & (F.col("price") >= F.col("bid_price"))) | ((F.col("kind") == "TLB") & (F.col("price") <= F.col("bid_price")))
    return ticks.join(requests, "symbol").filter(hit)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window; rows later than the watermark are dropped in a stream."""
    return _timed(events, late).groupBy(F.window("ts", length, slide or length).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", by: str = "user_id") -> DataFrame:
    """Sessions of one user, closed by a gap."""
    return _timed(events, late).groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
