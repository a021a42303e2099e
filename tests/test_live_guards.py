"""Live guards whose work follows the rows, not the number of keys, files or partitions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators import ordered as O
from tidemark.streaming import feeds
from tidemark.streaming.watchdog import Health


def test_small_files_make_one_batch(spark, tmp_path):
    sizes = []
    rows = spark.range(0, 900, 1, 9).withColumn("v", F.col("id") * 7919 % 900).repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = feeds.in_order(rows, ["v"], f"test-{tmp_path.name}")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    stream.writeStream.foreachBatch(lambda b, n: sizes.append(b.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert sizes == [900]


def test_echo_state_over_batches_with_nulls(spark, tmp_path):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, start + timedelta(seconds=rng.randint(0, 200_000)), rng.choice([None, *range(40), 1 << 60, (1 << 60) + 1]), rng.choice(["record", "probe"]), rng.choice([None, 0, 1, 1 << 60])) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key long, kind string, sha long")
    stream = feeds.in_order(df, ["ts", "event_id"], f"test-{tmp_path.name}", rows_a_file=100)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    got = {tuple(r) for r in feeds.drain(feeds.live_echo(stream, 6 * 3600), spark, f"echo-{tmp_path.name}").select("event_id", "key", "suppressed").collect()}
    assert got == {tuple(r) for r in O.echo(df, "6 HOURS").select("event_id", "key", "suppressed").collect()}
    assert sum(r[2] for r in got) > 20 and any(r[1] is None for r in got)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_commits_do_not_grow_with_the_table(spark, sf, monkeypatch):
    """Before, a batch had 100,000 rows however many there were, and each rewrote all stores."""
    from tidemark.plans import registry, stream_queries

    sizes = []
    monkeypatch.setattr(stream_queries, "ROWS_A_COMMIT", 10)

    def ordered(rows, by, name, rows_a_file):
        sizes.append((rows.count(), rows_a_file))
        raise InterruptedError

    monkeypatch.setattr(feeds, "in_order", ordered)
    try:
        registry.queries()["snk4_commit_stores"](spark, sf)
    except InterruptedError:
        pass
    [(n, most)] = sizes
    assert n > 100 and most == -(-n // stream_queries.COMMITS)


def test_state_is_written_without_a_read_ahead_of_each_write(spark, tmp_path):
    """Before, the store counted its entries, which took most of a batch's time."""
    held, start = [], datetime(2024, 1, 1)

    class Seen(StreamingQueryListener):
        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            held.extend((o.numRowsUpdated, o.numRowsTotal) for o in event.progress.stateOperators)

        def onQueryTerminated(self, event):
            pass

    rows = [(i, start + timedelta(minutes=40 * i), i % 5) for i in range(100)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, key long")
    stream, seen, health = feeds.in_order(df, ["ts"], f"test-{tmp_path.name}", rows_a_file=25), Seen(), Health()
    spark.streams.addListener(seen)
    try:
        got = feeds.drain(feeds.live_bursts(stream, "30 minutes"), spark, f"bursts-{tmp_path.name}", health)
    finally:
        spark.streams.removeListener(seen)
    assert {(r["key"], r["start"], r["n"], r["last_id"]) for r in got.collect()} == {(k, t, 1, i) for i, t, k in rows[:-1]}
    assert sum(u for u, _ in held) >= 100 and {t for _, t in held} == {0}
