"""Offline certification of transaction histories, set-oriented.

reads:  (txn, key, version)  version = the writer whose version was read
writes: (txn, key, version)  version = the writer whose version was overwritten
txns:   (txn, begin_ts, commit_ts)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.scratch import saved


def dependencies(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Edges (src, dst, kind): wr reads what src wrote, ww overwrites it, rw overwrites what src read."""
    wr = reads.select(F.col("version").alias("src"), F.col("txn").alias("dst"), F.lit("wr").alias("kind"))
    ww = writes.select(F.col("version").alias("src"), F.col("txn").alias("dst"), F.lit("ww").alias("kind"))
    r, w = reads.alias("r"), writes.alias("w")
    rw = r.join(w, (F.col("r.key") == F.col("w.key")) & (F.col("r.version") == F.col("w.version"))).select(F.col("r.txn").alias("src"), F.col("w.txn").alias("dst"), F.lit("rw").alias("kind"))
    return wr.unionByName(ww).unionByName(rw).filter("src <> dst").distinct()


def ssn(txns: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Serial safety net: eta is the latest commit among a transaction's predecessors, pi the least pi among its successors over rw edges
    that committed before it, or its own commit; it must abort if pi <= eta.

    pi goes back along chains of such edges, as a successor's own pi was final when it committed. Rounds go on until none changes: as many as
    the longest chain has edges. Each transaction is judged as though all others had committed.
    """
    edges = dependencies(reads, writes)
    at = lambda n: txns.select(F.col("txn").alias(n), F.col("commit_ts").alias(f"{n}_ts"))
    past = edges.join(at("src"), "src").join(at("dst"), "dst")
    eta = past.filter("src_ts < dst_ts").groupBy(F.col("dst").alias("txn")).agg(F.max("src_ts").alias("eta"))
    back = saved(past.filter("kind = 'rw' and dst_ts < src_ts").select("src", "dst", F.col("dst_ts").alias("pi")), "rw-edges")
    pi = back.groupBy(F.col("src").alias("txn")).agg(F.min("pi").alias("pi"))
    while True:
        pi = saved(pi, "pi")
        further = back.join(pi.select(F.col("txn").alias("dst"), F.col("pi").alias("further")), "dst").groupBy(F.col("src").alias("txn")).agg(F.min("further").alias("further"))
        now = pi.join(further, "txn", "left").select("txn", F.least("pi", "further").alias("now"), "pi")
        if now.filter("now < pi").isEmpty():
            break
        pi = now.select("txn", F.col("now").alias("pi"))
    out = txns.select("txn", "begin_ts", "commit_ts").join(eta, "txn", "left").join(pi, "txn", "left")
    out = out.withColumn("eta", F.coalesce("eta", F.lit(0).cast("long"))).withColumn("pi", F.least(F.coalesce("pi", F.col("commit_ts")), F.col("commit_ts")))
    return out.withColumn("abort", F.col("pi") <= F.col("eta"))


def dangerous(txns: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Serializable snapshot isolation: pivots T2 with rw edges T1 -> T2 -> T3 between concurrent transactions, T3 first to commit."""
    rw = dependencies(reads, writes).filter("kind = 'rw'")
    t = lambda n: txns.select(F.col("txn").alias(n), F.col("begin_ts").alias(f"{n}_b"), F.col("commit_ts").alias(f"{n}_c"))
    concurrent = lambda x, y: (F.col(f"{x}_b") < F.col(f"{y}_c")) & (F.col(f"{y}_b") < F.col(f"{x}_c"))
    a, b = rw.select(F.col("src").alias("t1"), F.col("dst").alias("t2")), rw.select(F.col("src").alias("t2"), F.col("dst").alias("t3"))
    out = a.join(b, "t2").join(t("t1"), "t1").join(t("t2"), "t2").join(t("t3"), "t3")
    return out.filter(concurrent("t1", "t2") & concurrent("t2", "t3") & (F.col("t3_c") <= F.col("t1_c")) & (F.col("t3_c") < F.col("t2_c"))).select("t1", "t2", "t3").distinct()


def stale_reads(txns: DataFrame, reads: DataFrame, writes: DataFrame) -> DataFrame:
    """Multi-version optimistic check: transactions that read a version which a smaller commit stamp had overwritten."""
    t = txns.select("txn", "commit_ts")
    over = writes.join(t, "txn").select("key", "version", F.col("commit_ts").alias("over_ts"))
    return reads.join(t, "txn").join(over, ["key", "version"]).filter("over_ts < commit_ts").select("txn").distinct()
