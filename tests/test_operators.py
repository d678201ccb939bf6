import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import functions as fn
from tidemark import plans, sources
from tidemark.operators import access, bands, loading, lots, serial, versions
from tidemark.sources.catalog import Catalog
from tidemark.streaming import feeds


@pytest.fixture
def log(spark):
    rows = [("a", "1", 1, "I"), ("b", "1", 1, "I"), ("a", "2", 3, "U"), ("b", None, 4, "D"), ("c", "1", 5, "I"), ("b", "9", 6, "I")]
    return spark.createDataFrame(rows, "key string, value string, commit_ts long, op string")


def test_ranges(spark):
    df = spark.createDataFrame([(a, b, 10 * a + b) for a in range(4) for b in range(4)], "a int, b int, v int")
    got = lambda *x, **y: [r.v for r in access.scan(df, ["a", "b"], *x, **y).collect()]
    assert got([1, 2], [2, 1]) == [12, 13, 20]  # start in, end out
    assert got([2, 1], [1, 2], reverse=True) == [21, 20, 13]  # start in, end out, downward
    assert got([2, 1], [2, 1]) == [] and got([3, 0], [1, 0]) == []
    assert got(None, [0, 2]) == [0, 1] and got([3, 2], None) == [32, 33]
    assert got([1, 0], limit=2) == [10, 11]


def test_seed_files(spark, tmp_path):
    (tmp_path / "seed.txt").write_text("1\tAlpha\t2.5\n2\t\t-1\n")
    assert [tuple(r) for r in sources.read_flat(spark, str(tmp_path / "seed.txt"), "id int, name string, rate double").collect()] == [(1, "Alpha", 2.5), (2, None, -1.0)]
    (tmp_path / "bad.txt").write_text("x\tAlpha\t2.5\n")
    with pytest.raises(Exception, match="MALFORMED"):
        sources.read_flat(spark, str(tmp_path / "bad.txt"), "id int, name string, rate double").collect()


def test_pulled_scan(spark):
    df = spark.range(1000).repartition(8)
    rows = access.pull(df, ["id"], [10], [900])
    assert [next(rows).id for _ in range(5)] == [10, 11, 12, 13, 14]
    assert [r.id for r in access.pull(df, ["id"], [3], [-1], reverse=True)] == [3, 2, 1, 0]


def test_catalog(spark, tmp_path):
    c = Catalog(str(tmp_path / "c")).create(spark)
    t = c.create_table(spark, "t", "a long, b string", ["a"])
    c.create_index(spark, "b_once", "t", ["b"], unique=True)
    with pytest.raises(ValueError):
        c.create_table(spark, "t", "a long", ["a"])
    with pytest.raises(KeyError):
        c.create_index(spark, "x", "nowhere", ["a"])
    rows = lambda *x: spark.createDataFrame(list(x), "a long, b string, op string")
    assert t.commit(spark, rows((1, "x", "I"), (2, "y", "I")), 0) == versions.Result.OK
    assert c.table(spark, "t").commit(spark, rows((3, "x", "I")), 1) == versions.Result.DUPLICATE_KEY
    assert [tuple(r) for r in c.build(spark, "b_once").orderBy("b").collect()] == [(1, "x"), (2, "y")]
    c.drop(spark, "t")
    with pytest.raises(KeyError):
        c.table(spark, "t")
    assert c.entries().size(spark) == 0 and c.entries().at(spark, 2).count() == 3  # as of an earlier stamp


def test_snapshots(log):
    at = lambda ts: {r.key: r.value for r in versions.snapshot(log, ["key"], ts).collect()}
    assert at(1) == {"a": "1", "b": "1"} and at(4) == {"a": "2"} and at(9) == {"a": "2", "b": "9", "c": "1"} and at(0) == {}
    assert versions.gc_keep(log, ["key"], 4).count() == 4


def _staged(spark, *rows):
    return spark.createDataFrame(list(rows), "key string, value string, op string")


def _state(rows):
    return {r.key: r.value for r in rows.collect()}


def test_commit_checks(spark, tmp_path):
    table = versions.VersionedTable(str(tmp_path / "log"), ["key"]).create(spark, "key string, value string")
    R = versions.Result
    assert table.watermark(spark) == 0 and table.size(spark) == 0
    assert table.commit(spark, _staged(spark, ("a", "1", "I"), ("b", "1", "I")), 0) == R.OK  # the first commit of a new table
    assert table.commit(spark, _staged(spark, ("a", "2", "U")), 1) == R.OK
    assert table.commit(spark, _staged(spark, ("a", "3", "U")), 1) == R.SI_CONFLICT
    assert table.commit(spark, _staged(spark, ("b", "3", "I")), 2) == R.DUPLICATE_KEY
    assert table.commit(spark, _staged(spark, ("x", "3", "U")), 2) == R.MISSING_KEY
    assert table.commit(spark, _staged(spark, ("n", "1", "I"), ("n", "2", "I")), 2) == R.DUPLICATE_KEY
    assert table.commit(spark, _staged(spark, ("c", "1", "I")), 2, 2) == R.SI_CONFLICT  # the stamp is taken
    assert table.commit(spark, _staged(spark, ("b", None, "D")), 2) == R.OK
    assert _state(table.at(spark)) == {"a": "2"} and _state(table.at(spark, 1)) == {"a": "1", "b": "1"}
    assert table.size(spark) == 1 and table.size(spark, deleted=True) == 2
    snaps = str(tmp_path / "snap")
    for ts in (1, 2, 3):
        table.checkpoint(spark, snaps, ts)
    assert sources.complete(spark, snaps, "snapshot_ts") == [2, 3]  # older ones are scavenged
    for warm in ("none", "lazy", "eager"):
        assert _state(table.recover(spark, snaps, 2, warm)) == {"a": "2"}  # the delete after the checkpoint counts
    assert _state(table.recover(spark, snaps)) == {"a": "2"}
    other = table.compact(spark, str(tmp_path / "small"), 2)
    assert _state(other.at(spark, 2)) == {"a": "2", "b": "1"} and _state(other.at(spark)) == {"a": "2"} and other.log(spark).count() == 3
    with pytest.raises(ValueError):
        versions.VersionedTable(str(tmp_path / "log"), ["key"]).create(spark, "key string, value string")
    table.clear(spark)
    assert table.size(spark, deleted=True) == 0 and table.watermark(spark) == 0


def test_lost_writers(spark, tmp_path):
    """A claim keeps others away until the writer ends; a batch whose write has not ended is not read."""
    table = versions.VersionedTable(str(tmp_path / "log"), ["key"]).create(spark, "key string, value string")
    assert sources.claim(spark, table.path, 1) and not sources.claim(spark, table.path, 1)
    _staged(spark, ("z", "9", "I")).write.parquet(f"{table.path}/commit_ts=1")
    (tmp_path / "log/commit_ts=1/_SUCCESS").unlink()
    assert table.size(spark) == 0 and table.commit(spark, _staged(spark, ("a", "1", "I")), 0) == versions.Result.SI_CONFLICT
    table.repair(spark)
    assert table.commit(spark, _staged(spark, ("a", "1", "I")), 0, 7) == versions.Result.OK and table.watermark(spark) == 7
    assert table.commit(spark, _staged(spark, ("b", "1", "I")), 7) == versions.Result.OK and _state(table.at(spark)) == {"a": "1", "b": "1"}


def test_transactions(spark, tmp_path):
    R = versions.Result
    table = versions.VersionedTable(str(tmp_path / "log"), ["key"], unique=[["value"]]).create(spark, "key string, value string")
    rows = lambda *x: spark.createDataFrame(list(x), "key string, value string")
    t = table.begin(spark)
    t.write(rows(("a", "1"), ("b", "2"), ("c", "3")), "I")
    t.write(rows(("a", "9")), "U")
    t.write(rows(("c", "3")), "D")  # made and deleted by one transaction
    assert _state(t.read()) == {"a": "9", "b": "2"} and t.commit() == R.OK
    assert _state(table.at(spark)) == {"a": "9", "b": "2"}
    dup = table.begin(spark)
    dup.write(rows(("d", "2")), "I")
    assert dup.commit() == R.DUPLICATE_KEY  # the secondary key
    one, two, three, four = (table.begin(spark) for _ in range(4))
    assert one.scan(F.col("key") < "m").count() == 2 and three.scan(F.col("key") == "b").count() == 1
    two.write(rows(("e", "5")), "I")
    two.write(rows(("b", "6")), "U")
    assert two.commit() == R.OK
    one.write(rows(("x", "7")), "I")
    three.write(rows(("y", "8")), "I")
    four.write(rows(("w", "0")), "I")
    assert one.commit() == R.PHANTOM and three.commit() == R.RW_CONFLICT and four.commit(certify=lambda: True) == R.SERIAL and four.abort() == R.USER
    with pytest.raises(ValueError):
        table.begin(spark, read_only=True).write(rows(("q", "q")), "I")
    assert table.commit_group(spark, [_staged(spark, ("f", "10", "I")), _staged(spark, ("f", "11", "I")), _staged(spark, ("g", "12", "I")), _staged(spark, ("h", "10", "I"))], table.watermark(spark)) == [R.OK, R.SI_CONFLICT, R.OK, R.DUPLICATE_KEY]
    tries = []

    def run(random):
        t = table.begin(spark, read_ts=1 if not tries else None)  # too old at first
        tries.append(random.random())
        t.write(rows(("b", "20")), "U")
        return t.commit()

    assert versions.with_retry(run) == R.OK and len(tries) == 2 and tries[0] == tries[1]


def test_lots(spark):
    rows = [("x", dt.datetime(2024, 1, i), i, q) for i, q in ((1, 5.0), (2, 3.0), (3, 4.0))]
    df = spark.createDataFrame(rows, "acct string, dts timestamp, lot int, qty double")
    take = lambda need, **k: [r.taken for r in lots.consume(df, ["acct"], ["dts", "lot"], "qty", F.lit(need), **k).orderBy("lot").collect()]
    assert take(6.0) == [5, 1, 0] and take(6.0, lifo=True) == [0, 2, 4] and take(99.0) == [5, 3, 4] and take(0.0) == [0, 0, 0] and take(5.0) == [5, 0, 0]


def test_bands_and_as_of(spark):
    b = spark.createDataFrame([(1, 10, 0.1), (11, 25, 0.2)], "lo int, hi int, rate double")
    v = spark.createDataFrame([(x,) for x in (0, 1, 10, 11, 25, 26)], "v int")
    assert sorted((r.v, r.rate) for r in bands.band_join(v, b, "v", "lo", "hi", 10).collect()) == [(1, 0.1), (10, 0.1), (11, 0.2), (25, 0.2)]
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "a"), (1, 5, "b")], "k int, u int, x string")
    assert sorted((r.k, r.t, r.x or "") for r in bands.as_of(left, right, ["k"], "t", "u", ["x"]).collect()) == [(1, 1, ""), (1, 5, "b"), (2, 9, "")]


def test_as_of_in_cells(spark):
    r = random.Random(5)
    left = [(r.randrange(3), r.randrange(1000)) for _ in range(300)] + [(None, 4), (9, 0)]
    right = [(r.randrange(3), i * 7, f"x{i}") for i in range(120)] + [(None, 2, "n")]
    a, b = spark.createDataFrame(left, "k int, t int"), spark.createDataFrame(right, "k int, u int, x string")
    want = sorted((k, t, max(((u, x) for j, u, x in right if j == k and u <= t), default=(0, None))[1]) for k, t in left if k is not None)
    for cell in (None, 5, 50, 10**6):
        assert sorted((x.k, x.t, x.x) for x in bands.as_of(a, b, ["k"], "t", "u", ["x"], cell).collect() if x.k is not None) == want
        assert [x.x for x in bands.as_of(a, b, ["k"], "t", "u", ["x"], cell).filter("k is null").collect()] == ["n"]


def test_matching_by_walking(spark):
    """Lots and sells against two queues; ends that meet, sells beyond all lots, groups with one side only, null keys."""
    r = random.Random(6)
    lot = [(g, i, float(r.randrange(1, 6))) for g in ("a", "b", "c", None) for i in range(40)]
    sell = [(g, i, float(r.randrange(1, 9))) for g in ("a", "b", "d", None) for i in range(r.randrange(10, 60))]
    got = lots.match(spark.createDataFrame(lot, "g string, lot int, q double"), spark.createDataFrame(sell, "g string, sell int, s double"), ["g"], ["lot"], ["sell"], "q", "s")
    want = []
    for g in ("a", "b", None):
        queue = [[i, q] for h, i, q in lot if h == g]
        for h, j, s in sell:
            while h == g and s and queue:
                take = min(s, queue[0][1])
                want.append((g, queue[0][0], j, take))
                s, queue[0][1] = s - take, queue[0][1] - take
                if not queue[0][1]:
                    queue.pop(0)
    assert sorted(((x.g, x.lot, x.sell, x.matched) for x in got.collect()), key=repr) == sorted(want, key=repr)


def test_places_in_a_whole_table(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)] + [(5, -1), (5, -2)], "a int, b int").repartition(7)
    got = access.ranked(df, [F.col("a").desc(), F.col("b").asc()]).collect()
    assert [(x.a, x.b) for x in sorted(got, key=lambda x: x.pos)] == sorted(((x.a, x.b) for x in got), key=lambda x: (-x[0], x[1])) and sorted(x.pos for x in got) == list(range(1, 1003))


def test_scans_with_gaps(spark, tmp_path):
    """Places of a range are counted, not taken from the keys."""
    spark.createDataFrame([(k, k, 1.0) for k in (3, 10, 13, 17, 20, 25)], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    at = lambda q: [(r.pos, r.o_orderkey) for r in plans.QUERIES[q](spark, str(tmp_path)).collect()]
    assert at("scan_forward") == [(1, 10), (2, 13), (3, 17)] and at("scan_reverse") == [(1, 20), (2, 17), (3, 13)]


def test_write_skew_is_caught(spark):
    txns = spark.createDataFrame([(0, 0, 1), (1, 2, 10), (2, 3, 11)], "txn long, begin_ts long, commit_ts long")
    reads = spark.createDataFrame([(1, "x", 0), (1, "y", 0), (2, "x", 0), (2, "y", 0)], "txn long, key string, version long")
    writes = spark.createDataFrame([(1, "x", 0), (2, "y", 0)], "txn long, key string, version long")
    got = {r.txn: r.abort for r in serial.ssn(txns, reads, writes).collect()}
    assert got[2] and not got[0]
    assert serial.dangerous(txns, reads, writes).count() >= 1


def test_stamps_go_back_along_chains(spark):
    """T1 reads what T2 overwrote, T2 what T3 overwrote, committed at 30, 20 and 10; T1 also reads a version of 15."""
    txns = spark.createDataFrame([(0, 0, 1), (4, 0, 15), (1, 5, 30), (2, 5, 20), (3, 5, 10)], "txn long, begin_ts long, commit_ts long")
    reads = spark.createDataFrame([(1, "x", 0), (1, "z", 4), (2, "y", 0)], "txn long, key string, version long")
    writes = spark.createDataFrame([(2, "x", 0), (3, "y", 0)], "txn long, key string, version long")
    got = {r.txn: (r.eta, r.pi, r.abort) for r in serial.ssn(txns, reads, writes).collect()}
    assert got[1] == (15, 10, True) and got[2] == (1, 10, False) and got[3] == (1, 10, False) and got[4] == (0, 15, False)


def test_generators(spark):
    u = spark.range(20000).select(fn.random(F.col("id"), 1).alias("u"), fn.random(F.col("id"), 2).alias("v"))
    x = u.select(fn.zipf(F.col("u"), 50).alias("z"), fn.hot(F.col("u"), F.col("v"), 1, 100).alias("h"), fn.nurand(F.col("u"), F.col("v"), 255, 3, 1, 1000).alias("n"), fn.uniform(F.col("u"), 5, 9).alias("f"))
    rows = x.collect()
    zeta = sum(k**-0.99 for k in range(1, 51))
    assert abs(sum(r.z == 1 for r in rows) / 20000 - 1 / zeta) < 0.02 and {r.z for r in rows} <= set(range(1, 51))
    assert abs(sum(r.h <= 20 for r in rows) / 20000 - 0.8) < 0.02 and {r.f for r in rows} == {5, 6, 7, 8, 9} and all(1 <= r.n <= 1000 for r in rows)
    assert sorted(sum(r.f == k for r in rows) for k in range(5, 10))[0] > 3500


def test_bulk_load_finds_losses(spark, tmp_path, monkeypatch):
    table = versions.VersionedTable(str(tmp_path / "log"), ["key"]).create(spark, "key string, value string")
    rows = spark.createDataFrame([(str(i), "v") for i in range(50)], "key string, value string")
    loading.bulk_load(spark, table, rows, 4)
    assert table.size(spark) == 50 and table.watermark(spark) == 4
    with pytest.raises(ValueError):
        loading.bulk_load(spark, table, rows)  # the keys are there
    monkeypatch.setattr(versions.VersionedTable, "at", lambda self, spark: rows.limit(49))
    with pytest.raises(ValueError):
        loading.bulk_load(spark, versions.VersionedTable(str(tmp_path / "other"), ["key"]).create(spark, "key string, value string"), rows)


def test_replay_equals_batch(spark, log, tmp_path):
    for i, part in enumerate((log.filter("commit_ts <= 3"), log.filter("commit_ts > 3"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    feeds.replay(source, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.key: r.value for r in feeds.read_view(spark, str(tmp_path / "out"), ["key"]).collect()} == {"a": "2", "b": "9", "c": "1"}
    (tmp_path / "out/batch=1/_SUCCESS").unlink()  # a batch whose write has not ended
    assert {r.key: r.value for r in feeds.read_view(spark, str(tmp_path / "out"), ["key"]).collect()} == {"a": "2", "b": "1"}


def test_replica_follows(spark, log, tmp_path):
    log.filter("commit_ts <= 3").coalesce(1).write.parquet(str(tmp_path / "in/part0"))
    source = spark.readStream.schema(log.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = feeds.replay(source, str(tmp_path / "out"), str(tmp_path / "cp"), every="100 milliseconds")
    query.processAllAvailable()
    assert {r.key: r.value for r in feeds.read_view(spark, str(tmp_path / "out"), ["key"]).collect()} == {"a": "2", "b": "1"}
    log.filter("commit_ts > 3").coalesce(1).write.parquet(str(tmp_path / "in/part1"))
    query.processAllAvailable()
    query.stop()
    assert {r.key: r.value for r in feeds.read_view(spark, str(tmp_path / "out"), ["key"]).collect()} == {"a": "2", "b": "9", "c": "1"}


def test_commands_are_run_again(spark, tmp_path):
    commands = spark.createDataFrame([("pay", "a", 5, 1), ("pay", "b", 7, 2), ("close", "a", None, 3)], "kind string, key string, amount int, commit_ts long")
    commands.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(commands.schema).parquet(str(tmp_path / "in"))
    handlers = {"pay": lambda c: c.select("key", F.col("amount").cast("string").alias("value"), "commit_ts", F.lit("U").alias("op")), "close": lambda c: c.select("key", F.lit(None).cast("string").alias("value"), "commit_ts", F.lit("D").alias("op"))}
    feeds.redo(source, handlers, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {r.key: r.value for r in feeds.read_view(spark, str(tmp_path / "out"), ["key"]).collect()} == {"b": "7"}


def test_feed_submits_once(spark, tmp_path):
    """Ticks in two batches: a request goes out with the first tick that triggers it, in whatever batch."""
    requests = spark.createDataFrame([(1, "a", "TLS", 10.0), (2, "a", "TSL", 3.0), (3, "b", "TLB", 5.0)], "request long, symbol string, kind string, bid_price double")
    for i, ticks in enumerate(([("a", 11.0, 1), ("a", 12.0, 2), ("b", 9.0, 3)], [("a", 13.0, 4), ("a", 2.0, 5), ("b", 5.0, 6)])):
        spark.createDataFrame(ticks, "symbol string, price double, seq long").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
    source = spark.readStream.schema("symbol string, price double, seq long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    feeds.apply_ticks(source, requests, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((r.request, r.price, r.seq, r.batch) for r in spark.read.parquet(str(tmp_path / "out/submitted")).collect()) == [(1, 11.0, 1, 0), (2, 2.0, 5, 1), (3, 5.0, 6, 1)]
    assert sorted((r.symbol, r.price, r.batch) for r in spark.read.parquet(str(tmp_path / "out/prices")).collect()) == [("a", 2.0, 1), ("a", 12.0, 0), ("b", 5.0, 1), ("b", 9.0, 0)]


def test_late_rows_are_dropped(spark, tmp_path):
    """The second batch moves the watermark past the first window, and the fourth comes too late for it: a batch is held against the watermark of the one before."""
    at = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    for i, rows in enumerate(([(at(0, 10), "x", 1.0)], [(at(5), "x", 1.0)], [(at(5, 10), "x", 1.0)], [(at(0, 20), "x", 1.0), (at(4, 30), "x", 1.0)], [(at(23), "x", 1.0)], [(at(23, 30), "x", 1.0)])):
        spark.createDataFrame(rows, "ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / f"in/part{i}"))
        for f in (tmp_path / f"in/part{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))  # the order in which files are read
    source = spark.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = feeds.drained(feeds.windowed(source, "1 hour"), str(tmp_path / "out")).collect()
    assert sorted((r.start.hour, r.n) for r in got) == [(0, 1), (4, 1), (5, 2)]  # 0:20 is late, 4:30 is not
