"""Guards on one hot root against plain loops; stamps, the watch over them, and live bursts."""

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import ordered as O
from tidemark.streaming import feeds
from tidemark.streaming import watchdog as W

T0 = datetime(2024, 1, 1)


@pytest.fixture
def cut(spark):
    """Small tables are cut into as many ranges as large ones."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def events(n, kinds, seed):
    """Nearly all rows in one root; null roots, and many rows of one time."""
    r = random.Random(seed)
    return [(i, T0 + timedelta(seconds=r.randrange(n)), r.choice([None, 1, 2]) if r.random() < 0.05 else 0, r.choice(kinds), r.randrange(3)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id BIGINT, ts TIMESTAMP_NTZ, root BIGINT, kind STRING, sha BIGINT").repartition(7)


def by_root(rows):
    for root in {r[2] for r in rows}:
        yield root, sorted((r for r in rows if r[2] == root), key=lambda r: (r[1], r[0]))


def test_one_root_is_cut_into_ranges(spark, cut):
    ranges = O.ranged(frame(spark, events(4000, ["x"], 1)), "root", ["ts", "event_id"])
    assert ranges.filter("root = 0").select("range").distinct().count() >= 7


def test_streak_echo_and_cooldown_as_loops(spark, cut):
    rows = events(3000, ["record", "probe", "probe", "full", "full", "full"], 2)
    f = frame(spark, rows)
    streak, echoed, held = {}, {}, {}
    for _, own in by_root(rows):
        run, shut, rec, armed = 0, False, None, None
        for i, ts, _, kind, sha in own:
            run = run + 1 if kind == "full" else 0
            streak[i] = (run == 4 and not shut, shut or run == 4)
            shut = streak[i][1]
            held[i] = armed is not None and ts < armed + timedelta(seconds=2)
            armed = ts if kind == "full" and sha == 0 else armed
            if kind == "record":
                rec = (sha, ts)
            elif kind == "probe":
                echoed[i] = rec is not None and rec[0] == sha and ts < rec[1] + timedelta(seconds=3)
                rec = None if echoed[i] else rec
    got = O.capacity_streak(f.withColumn("is_cap", F.col("kind") == "full"), 4)
    assert {r["event_id"]: (r["tripped"], r["fenced"]) for r in got.collect()} == streak and any(s[0] for s in streak.values())
    got = O.echo(f.filter("kind <> 'full'").withColumnRenamed("root", "key"), "3 SECONDS")
    assert {r["event_id"]: r["suppressed"] for r in got.collect()} == echoed and any(echoed.values())
    got = O.cooldown(f.withColumn("arm", (F.col("kind") == "full") & (F.col("sha") == 0)), 2)
    assert {r["event_id"]: r["held"] for r in got.collect()} == held


def test_recovery_as_a_loop(spark, cut):
    rows = events(3000, ["queued", "queued", "sent", "alive", "full", None], 3)
    rows = [(i, T0 + (t - T0) * 100, *rest) for i, t, *rest in rows]
    want = {}
    for _, own in by_root(rows):
        pending, sign, run, shut, went = 0, None, 0, False, own[0][1]
        for i, ts, _, kind, _ in own:
            pending += (kind == "queued") - (kind == "sent")
            went, sign = ts if kind == "sent" else went, ts if kind == "alive" else sign
            run = run + 1 if kind == "full" else 0
            shut |= run == 3
            idle, silent = int((ts - went).total_seconds()), None if sign is None else int((ts - sign).total_seconds())
            want[i] = (pending, idle, silent, shut, W.trigger(pending, idle, shut, silent or 0))
    got = O.recovery(frame(spark, rows), 3)
    assert {r["event_id"]: (r["pending"], r["idle"], r["silent"], r["fenced"], r["trigger"]) for r in got.collect()} == want
    assert {w[4] for w in want.values()} >= {"push_stall", "watcher_fenced"}


def test_empty_guards(spark):
    f = frame(spark, [])
    assert O.capacity_streak(f.withColumn("is_cap", F.lit(True)), 2).count() == 0 and O.recovery(f, 2).count() == 0
    assert O.echo(f.withColumnRenamed("root", "key"), "1 SECOND").count() == 0


@pytest.mark.parametrize("state", [(0, 901, False, 0), (1, 899, False, 0), (1, 900, True, 999), (0, 0, True, 999), (0, 0, False, 300), (0, 0, False, 299), (5, 900, False, 0)])
def test_trigger_by_column_and_by_state(spark, state):
    got = spark.range(1).select(S.recovery_trigger(*map(F.lit, state)).alias("t")).first()["t"]
    assert got == W.trigger(*state) == {(1, 900, True, 999): "push_stall", (5, 900, False, 0): "push_stall", (0, 0, True, 999): "watcher_fenced", (0, 0, False, 300): "watcher_stale"}.get(state)


def test_a_stalled_stream_fires_once_and_a_busy_one_does_not(spark, tmp_path):
    now, seen = [0.0], []
    health = W.Health(clock=lambda: now[0])
    spark.streams.addListener(health)
    q = None
    try:
        q = spark.readStream.format("rate").option("rowsPerSecond", 50).load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
        dog = W.Watchdog(health, lambda: 3, seen.append, tick=0.02).start()
        for _ in range(8):  # far beyond the limits in all, but rows move in between
            mark, until = now[0], time.monotonic() + 30
            now[0] += 290
            while health.progress <= mark and time.monotonic() < until:
                time.sleep(0.02)
        assert not seen
    finally:
        if q:
            q.stop()
        until = time.monotonic() + 30
        while q and str(q.runId) not in health.ended and time.monotonic() < until:
            time.sleep(0.02)
        spark.streams.removeListener(health)
    now[0] += 901
    dog.thread.join(20)
    now[0] += 901
    time.sleep(0.1)
    assert seen == [W.Stall("push_stall", 3, seen[0].idle, True)] and seen[0].idle >= 901


def test_watch_without_streams():
    def broken():
        raise OSError

    now = [0.0]
    health = W.Health(clock=lambda: now[0])
    dog = W.Watchdog(health, broken, None, disabled=True)
    now[0] = 899.0
    assert dog.look() is None and health.silent() == 0
    now[0] = 900.0
    assert dog.look() == W.Stall("push_stall", 1, 900, False)
    health.fence()
    assert W.Watchdog(health, lambda: 0, None).look() == W.Stall("watcher_fenced", 0, 900, True)


def test_live_bursts_and_late_rows(spark, tmp_path):
    s = lambda n: T0 + timedelta(seconds=n)
    batches = [[(1, 7, s(0)), (2, 7, s(5)), (3, None, s(3))], [(4, 7, s(40)), (5, 8, s(41))], [(9, 8, s(42))], [(6, 7, s(2)), (7, 8, s(49))], [(8, 9, s(500))]]
    for i, b in enumerate(batches):
        spark.createDataFrame(b, "event_id BIGINT, key BIGINT, ts TIMESTAMP").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{i}"))
        time.sleep(1.1)
    stream = spark.readStream.schema("event_id BIGINT, key BIGINT, ts TIMESTAMP").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    health = W.Health()
    got = feeds.drain(feeds.live_bursts(stream, "10 seconds", late="20 seconds"), spark, f"test-{tmp_path.name}", health)
    # row 6 comes two batches after the watermark's move, which Spark drops by; the burst at 500 is still open
    assert {tuple(r) for r in got.collect()} == {(7, s(0), 2, 2), (None, s(3), 1, 3), (7, s(40), 1, 4), (8, s(41), 3, 9)} and health.late == 1
