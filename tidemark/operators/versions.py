"""A version log: rows (key..., value..., commit_ts, op) with op I, U or D.

A transaction reads the log at a stamp and stages changes; a commit checks the
staged keys against later commits, claims the next stamp and appends one batch.
Plain Parquet has no row-level update, and none is needed. The first batch of a table, stamp 0, is empty and holds its columns.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources import scratch, tables


class Result(Enum):
    """What became of a commit. Failures of the store are exceptions; they leave the log as it was."""

    OK = "ok"
    SI_CONFLICT = "si_conflict"  # another transaction wrote one of the keys, or took the stamp
    DUPLICATE_KEY = "duplicate_key"
    MISSING_KEY = "missing_key"
    PHANTOM = "phantom"  # keys came into a scanned range or left it
    RW_CONFLICT = "rw_conflict"  # a row of a scanned range has been overwritten
    SERIAL = "serial"  # a certifier asked for an abort
    USER = "user"  # the transaction gave up by itself


RETRY = frozenset({Result.SI_CONFLICT, Result.PHANTOM, Result.SERIAL, Result.RW_CONFLICT})


def visible(log: DataFrame, read_ts) -> DataFrame:
    """Versions committed at or before read_ts."""
    return log.filter(F.col("commit_ts") <= F.lit(read_ts))


def latest(log: DataFrame, keys: Sequence[str], seq: Sequence[str] = (), deleted: bool = False) -> DataFrame:
    """The newest version of each key, without tombstones unless asked for. seq breaks ties within a commit.

    Each task keeps one version of a key before the shuffle, so a key with many versions moves as one row per task.
    """
    rest = [c for c in log.columns if c not in keys]
    order = F.struct("commit_ts", *seq) if seq else F.col("commit_ts")
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_top")).select(*[f"_top.{c}" if c in rest else c for c in log.columns])
    return top if deleted or "op" not in log.columns else top.filter(F.col("op") != "D")


def snapshot(log: DataFrame, keys: Sequence[str], read_ts) -> DataFrame:
    """The table as a transaction that began at read_ts sees it."""
    return latest(visible(log, read_ts), keys)


def own_writes(log: DataFrame, staged: DataFrame, keys: Sequence[str], read_ts) -> DataFrame:
    """The snapshot with the transaction's own staged rows on top; of several writes of a key the last (seq) counts."""
    own = staged.withColumn("commit_ts", F.lit(read_ts).cast("long") + 1)
    base = visible(log, read_ts).withColumn("seq", F.lit(-1).cast("long"))
    return latest(base.unionByName(own, allowMissingColumns=True), keys, ["seq"])


def conflicts(log: DataFrame, staged: DataFrame, keys: Sequence[str], read_ts) -> DataFrame:
    """First updater wins: staged keys that another commit wrote after read_ts."""
    return staged.select(*keys).distinct().join(log.filter(F.col("commit_ts") > F.lit(read_ts)).select(*keys), list(keys), "left_semi")


def duplicate_inserts(log: DataFrame, staged: DataFrame, keys: Sequence[str], read_ts) -> DataFrame:
    """Staged inserts whose key is live in the snapshot. A deleted key may be inserted again."""
    return staged.filter("op = 'I'").select(*keys).distinct().join(snapshot(log, keys, read_ts).select(*keys), list(keys), "left_semi")


def missing_updates(log: DataFrame, staged: DataFrame, keys: Sequence[str], read_ts) -> DataFrame:
    """Staged updates and deletes whose key is neither live in the snapshot nor inserted by the same batch."""
    live = snapshot(log, keys, read_ts).select(*keys).unionByName(staged.filter("op = 'I'").select(*keys))
    return staged.filter("op <> 'I'").select(*keys).distinct().join(live, list(keys), "left_anti")


def phantoms(log: DataFrame, keys: Sequence[str], predicate, read_ts, commit_ts) -> DataFrame:
    """Keys of a scanned range whose membership or version changed between read_ts and commit_ts; `moved`: membership."""
    then, now = (snapshot(log, keys, ts).filter(predicate).select(*keys, F.col("commit_ts").alias(n)) for ts, n in ((read_ts, "_then"), (commit_ts, "_now")))
    both = then.join(now, list(keys), "full").filter(~F.col("_then").eqNullSafe(F.col("_now")))
    return both.select(*keys, (F.col("_then").isNull() | F.col("_now").isNull()).alias("moved"))


def repeated_keys(staged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a batch writes twice: without an order among its rows neither write would be the last."""
    return staged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*keys)


def not_unique(log: DataFrame, staged: DataFrame, keys: Sequence[str], unique: Sequence[str], read_ts) -> DataFrame:
    """Staged rows whose secondary key another live row has after the commit; null secondary keys are never equal."""
    written = staged.filter("op <> 'D'").select(*keys, *unique)
    live = snapshot(log, keys, read_ts).join(staged.select(*keys).distinct(), list(keys), "left_anti").select(*keys, *unique)
    taken = live.unionByName(written).groupBy(*unique).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return written.join(taken, list(unique), "left_semi")


def gc_keep(log: DataFrame, keys: Sequence[str], gc_ts) -> DataFrame:
    """What garbage collection keeps: every version after gc_ts, and of the older ones each key's newest."""
    old = latest(visible(log, gc_ts), keys, deleted=True)
    return log.filter(F.col("commit_ts") > F.lit(gc_ts)).unionByName(old)


@dataclass
class VersionedTable:
    """A version log in a folder. Writers may race: a stamp goes to the one that claims it, and a batch counts once its write has ended."""

    path: str
    keys: Sequence[str]
    unique: Sequence[Sequence[str]] = ()  # secondary keys, each unique among live rows

    def create(self, spark: SparkSession, schema: str) -> VersionedTable:
        """A table of no rows with the columns of `schema` (keys and values); fails if the folder has one already."""
        if not tables.claim(spark, self.path, 0):
            raise ValueError(f"{self.path} has a table already")
        tables.append_log(spark.createDataFrame([], f"{schema}, op string"), self.path, 0)
        return self

    def watermark(self, spark: SparkSession) -> int:
        """The newest stamp up to which all writes have ended."""
        return max(tables.complete(spark, self.path))

    def log(self, spark: SparkSession, read_ts: int | None = None) -> DataFrame:
        return tables.read_log(spark, self.path, read_ts)

    def at(self, spark: SparkSession, read_ts: int | None = None) -> DataFrame:
        return latest(self.log(spark, read_ts), self.keys)

    def size(self, spark: SparkSession, deleted: bool = False) -> int:
        """How many keys are live; with `deleted`, how many there ever were."""
        return latest(self.log(spark), self.keys, deleted=deleted).count()

    def clear(self, spark: SparkSession) -> None:
        """Back to no rows and stamp 0; nobody else may use the table meanwhile."""
        schema = self.log(spark).drop("commit_ts", "op").schema
        scratch.remove(spark, self.path)
        tables.claim(spark, self.path, 0)
        tables.append_log(spark.createDataFrame([], schema).withColumn("op", F.lit("")), self.path, 0)

    def check(self, spark: SparkSession, staged: DataFrame, read_ts: int, scanned: Sequence[Column] = ()) -> Result:
        """Whether a batch (key..., value..., op) that was read at read_ts may be committed now."""
        log, last = self.log(spark), self.watermark(spark)
        if not repeated_keys(staged, self.keys).isEmpty():
            return Result.DUPLICATE_KEY
        for found, what in ((conflicts, Result.SI_CONFLICT), (duplicate_inserts, Result.DUPLICATE_KEY), (missing_updates, Result.MISSING_KEY)):
            if not found(log, staged, self.keys, read_ts).isEmpty():
                return what
        if any(not not_unique(log, staged, self.keys, u, last).isEmpty() for u in self.unique):
            return Result.DUPLICATE_KEY
        for p in scanned:
            if (found := phantoms(log, self.keys, p, read_ts, last).agg(F.max("moved")).first()[0]) is not None:
                return Result.PHANTOM if found else Result.RW_CONFLICT
        return Result.OK

    def commit(self, spark: SparkSession, staged: DataFrame, read_ts: int, commit_ts: int | None = None, scanned: Sequence[Column] = ()) -> Result:
        """Check the staged batch and append it, or leave the log as it was. The stamp is the next one, or a given larger one."""
        last = self.watermark(spark)
        commit_ts = last + 1 if commit_ts is None else commit_ts
        if commit_ts <= last or not tables.claim(spark, self.path, last + 1):  # one writer at a time goes on from a stamp
            return Result.SI_CONFLICT
        done = False
        try:
            if (found := self.check(spark, staged, read_ts, scanned)) is Result.OK:
                tables.append_log(staged, self.path, commit_ts)
                done = True
        finally:
            if not done:
                self.repair(spark, last, commit_ts)
        return found

    def repair(self, spark: SparkSession, last: int | None = None, commit_ts: int | None = None) -> None:
        """Take back the claim after the stamp `last` (the newest one) and what was written for it, of a writer that is gone."""
        last = self.watermark(spark) if last is None else last
        for ts in {last + 1, commit_ts or last + 1}.difference(tables.complete(spark, self.path)):
            scratch.remove(spark, f"{self.path}/commit_ts={ts}")
        scratch.remove(spark, f"{self.path}/_claims/{last + 1}")

    def commit_group(self, spark: SparkSession, batches: Sequence[DataFrame], read_ts: int) -> list[Result]:
        """Group commit: several batches read at one stamp, in turn, in one append; a batch that writes a key of one before it has a conflict."""
        results, group = [], None
        for staged in batches:
            if group is not None and not staged.join(group.select(*self.keys), list(self.keys), "left_semi").isEmpty():
                results.append(Result.SI_CONFLICT)
                continue
            together = staged if group is None else group.unionByName(staged)
            results.append(self.check(spark, together, read_ts))
            group = together if results[-1] is Result.OK else group
        if group is not None and (found := self.commit(spark, group, read_ts)) is not Result.OK:
            results = [found if r is Result.OK else r for r in results]
        return results

    def begin(self, spark: SparkSession, read_only: bool = False, read_ts: int | None = None) -> Transaction:
        """A transaction that reads at the watermark, or at an earlier stamp."""
        return Transaction(spark, self, self.watermark(spark) if read_ts is None else read_ts, read_only)

    def checkpoint(self, spark: SparkSession, to: str, ts: int, keep: int = 2) -> str:
        """The newest versions at ts in a folder named by ts; of older complete snapshots the newest `keep` - 1 stay."""
        out = tables.write_snapshot(self.at(spark, ts), to, ts)
        for old in tables.complete(spark, to, "snapshot_ts")[:-keep]:
            scratch.remove(spark, f"{to}/snapshot_ts={old}")
        return out

    def recover(self, spark: SparkSession, snapshots: str, ts: int | None = None, warm: str = "none") -> DataFrame:
        """The newest state from the newest complete checkpoint (or the one taken at ts) and the tail of the log; deletes count.

        warm: none, lazy (kept in memory as it is read) or eager (read now).
        """
        ts = max(tables.complete(spark, snapshots, "snapshot_ts")) if ts is None else ts
        base, tail = spark.read.parquet(f"{snapshots}/snapshot_ts={ts}"), tables.read_log(spark, self.path, after=ts)
        out = latest(base.unionByName(tail), self.keys)
        if warm != "none":
            out = out.persist()
        if warm == "eager":
            out.count()
        return out

    def compact(self, spark: SparkSession, to: str, gc_ts: int) -> VersionedTable:
        """A copy of the table without the versions that no reader at gc_ts or later can see."""
        log = self.log(spark)
        other = VersionedTable(to, self.keys, self.unique).create(spark, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema if f.name not in ("op", "commit_ts")))
        kept = scratch.saved(gc_keep(log, self.keys, gc_ts).filter("commit_ts > 0"), "compacted")
        for ts in tables.complete(spark, self.path)[1:]:
            tables.claim(spark, to, ts)
            tables.append_log(kept.filter(F.col("commit_ts") == ts), to, ts)
        return other


@dataclass
class Transaction:
    """Reads at one stamp, sees its own writes, and commits or aborts them as one batch; the last write of a key counts."""

    spark: SparkSession
    table: VersionedTable
    read_ts: int
    read_only: bool = False
    staged: list[DataFrame] = field(default_factory=list)
    scanned: list[Column] = field(default_factory=list)

    def read(self) -> DataFrame:
        log = self.table.log(self.spark, self.read_ts)
        return own_writes(log, self._rows(), self.table.keys, self.read_ts).drop("seq", "commit_ts", "op") if self.staged else latest(log, self.table.keys).drop("commit_ts", "op")

    def scan(self, predicate: Column) -> DataFrame:
        """Rows of a range, which must not change until the commit."""
        self.scanned.append(predicate)
        return self.read().filter(predicate)

    def write(self, rows: DataFrame, op: str) -> None:
        """Stage inserts (I), updates (U) or deletes (D)."""
        if self.read_only:
            raise ValueError("the transaction only reads")
        self.staged.append(rows.withColumn("op", F.lit(op)))

    def _rows(self) -> DataFrame:
        out = None
        for i, rows in enumerate(self.staged):
            rows = rows.withColumn("seq", F.lit(i).cast("long"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def commit(self, certify: Callable[[], bool] | None = None) -> Result:
        """Check and append what was staged. certify may ask for an abort, as the certifiers of serial.py do over a history."""
        if certify and certify():
            self.abort()
            return Result.SERIAL
        if not self.staged:
            return Result.OK
        keys, rows = self.table.keys, self._rows()
        live = snapshot(self.table.log(self.spark), keys, self.read_ts).select(*keys).withColumn("_live", F.lit(True))
        if not repeated_keys(rows, [*keys, "seq"]).isEmpty():
            return Result.DUPLICATE_KEY
        # one row a key: its last write, as an insert where its first one was an insert of a key that was not live
        value = [c for c in rows.columns if c not in (*keys, "seq", "op")]
        one = rows.groupBy(*keys).agg(F.max_by(F.struct(*value, "op"), "seq").alias("t"), F.min_by("op", "seq").alias("_first")).join(live, list(keys), "left")
        op = F.when((F.col("_first") == "I") & (F.col("t.op") == "U"), "I").when((F.col("_first") == "D") & (F.col("t.op") == "I"), "U").otherwise(F.col("t.op"))
        gone = (F.col("_first") == "I") & (F.col("t.op") == "D") & F.col("_live").isNull()  # made and deleted by this transaction
        batch = one.filter(~gone).select(*keys, *[f"t.{c}" for c in value], op.alias("op"))
        return self.table.commit(self.spark, scratch.saved(batch, "staged"), self.read_ts, scanned=self.scanned)

    def abort(self) -> Result:
        """Drop what was staged; nothing of it has reached the log."""
        self.staged.clear()
        return Result.USER


def with_retry(run: Callable[[random.Random], Result], attempts: int = 5, seed: int = 1, wait: float = 0.01) -> Result:
    """Run a transaction until it commits or may not be tried again: each time with the same random numbers, after a wait that doubles."""
    for k in range(attempts):
        if (found := run(random.Random(seed))) not in RETRY:
            return found
        time.sleep(wait * 2**k)
    return found
