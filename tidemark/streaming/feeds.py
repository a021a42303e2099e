"""Live forms: event feeds replayed to a store, and guards with keyed state."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.plans.staging import shared_dir
from tidemark.streaming.watchdog import Health

ENVELOPE = "path STRING, phase STRING"


def decode_feed(events: DataFrame, roots=(), excludes=()) -> DataFrame:
    """Finished notifications on safe paths in scope: event_id, path, op, seq. Others, and messages without a readable operation, are dropped and move no cursor."""
    e = events.filter("event_type = 'enrichment_complete'").withColumn("d", F.from_json("data", ENVELOPE)).filter("d.path IS NOT NULL")
    e = e.select("event_id", "d.path", S.op_of(F.col("data")).alias("op"), S.seq_of(F.col("data")).alias("seq"))
    return e.filter("op IS NOT NULL").filter(P.is_safe(F.col("path")) & P.in_scope(F.col("path"), roots, excludes))


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each path, by position and then arrival."""
    return rows.groupBy("path").agg(F.max(F.struct("seq", "event_id", "op")).alias("m")).select("path", "m.seq", "m.event_id", "m.op")


STORE = "path STRING, seq BIGINT, event_id BIGINT, op STRING"
BUCKETS = 64


def _held(spark: SparkSession, base: str, before: int) -> dict[int, list[int]]:
    """Numbers of the micro-batches below `before` that wrote each bucket, newest first."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out: dict[int, list[int]] = {}
    for s in fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/v*/bucket=*")) or []:
        number, bucket = int(s.getPath().getParent().getName()[1:]), int(s.getPath().getName().partition("=")[2])
        if number < before:
            out.setdefault(bucket, []).append(number)
    return {b: sorted(n, reverse=True) for b, n in out.items()}


def _store(spark: SparkSession, base: str, before: int, only: set[int] | None = None) -> DataFrame:
    paths = [f"{base}/v{n[0]}/bucket={b}" for b, n in _held(spark, base, before).items() if only is None or b in only]
    return spark.read.schema(STORE).parquet(*paths) if paths else spark.createDataFrame([], STORE)


def replay(stream: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    """Run a feed to its end and return the store: path, seq, event_id, op; deletes leave a row with op DELETE.

    The store lies in BUCKETS buckets of paths. A micro-batch writes the buckets that it touches under its own number, merged
    with what the newest earlier batch left of them: a batch that is run again after a failure writes the same rows, so
    replays change nothing. Of each bucket that was touched, older versions than the one merged are removed. The
    checkpoint holds the feed's offset.
    """
    base = f"{shared_dir(spark)}/{name}"
    bucket = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")

    def merge(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        fresh = latest(batch).persist()
        try:
            touched = {r["bucket"] for r in fresh.select(bucket).distinct().collect()}
            merged = latest(_store(s, base, number, touched).unionByName(fresh))
            merged.select("*", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/v{number}")
        finally:
            fresh.unpersist()
        jvm = s.sparkContext._jvm
        for b, versions in _held(s, base, number).items():
            for old in versions[1:] if b in touched else ():
                path = jvm.org.apache.hadoop.fs.Path(f"{base}/v{old}/bucket={b}")
                path.getFileSystem(s.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return _store(spark, base, 1 << 62)


def watch_folder(spark: SparkSession, root: str, roots=(), excludes=(), allowed=(".md",)) -> DataFrame:
    """A stream of the files that come into a folder (or change there), as the manifest has them: path, content_hash,
    size_bytes, modified. Paths are filtered as on a scan. Removals are no events of a file stream; a scan finds them."""
    schema = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)
    lead = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", ""), f"^/*{re.escape(lead)}/+", "")
    passed = P.write_filter(rel, roots, excludes, allowed)["decision"] == "allow"
    return rows.filter(passed).select(rel.alias("path"), F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def in_order(rows: DataFrame, order: list[str], name: str, rows_a_file: int = 1_000_000) -> DataFrame:
    """`rows` as a stream of micro-batches of at most `rows_a_file` rows, in the order of the columns `order`.

    The rows are written to files of at most that size, range by range; the stream takes them by times set here in the order of
    the files, as many at a time as the bound allows for the largest. So a key has no more rows in a batch than that, and none of them comes late.
    """
    spark, base = rows.sparkSession, f"{shared_dir(rows.sparkSession)}/{name}"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows_a_file).parquet(base)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [f.getPath() for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
    # part-<range>-<id>-c<file of the range>
    place = lambda f: (int(f.getName().split("-")[1]), int(f.getName().split("-c")[-1].split(".")[0]))
    first = fs.getFileStatus(path).getModificationTime() - 10 * len(files)
    for i, f in enumerate(sorted(files, key=place)):
        fs.setTimes(f, first + 10 * i, -1)
    held = spark.read.schema(rows.schema).parquet(base).groupBy("_metadata.file_path").count().agg(F.max("count")).first()[0]
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", max(1, rows_a_file // (held or 1))).parquet(base)


#: Groups of keys that a guard keeps in one entry of its state: a call for each key costs more than its few rows.
SLOTS = 1024


class EchoGuard(StatefulProcessor):
    """The last record of each key of a slot, used up by the first probe that it matches within the TTL.

    A record is dropped when the watermark passes its end, so keys that fall silent leave nothing behind. Times are microseconds; the
    state's bytes are four rows of integers: keys, whether they are null, hashes and times.
    """

    def __init__(self, ttl_seconds: float):
        self.ttl = int(ttl_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "records BINARY")

    def _ends(self, t: np.ndarray) -> int:
        return (int(t.max()) + self.ttl) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts, state = list(rows), self.held.get()
        old = np.frombuffer(bytes(state[0]) if state else b"", np.int64).reshape(4, -1)
        n = old.shape[1]
        of = lambda name, ahead: np.concatenate([ahead, *(p[name].to_numpy() for p in parts)])
        ones = np.ones(n, bool)
        t, ids, keys, none, sha = of("t", old[3]), of("event_id", old[3]), of("key", old[0]), of("no_key", old[1] > 0), of("sha", old[2])
        record, known, came = of("record", ones), of("known", ones), np.arange(len(t)) >= n
        turn = np.lexsort((ids, t, came, keys, none))
        t, ids, keys, none, sha, record, known, came = (x[turn] for x in (t, ids, keys, none, sha, record, known, came))
        place = np.arange(len(t))
        opens = np.append(True, (keys[1:] != keys[:-1]) | (none[1:] != none[:-1]))
        opened = np.maximum.accumulate(np.where(opens, place, 0))
        last = np.maximum.accumulate(np.where(record, place, -1))
        armed = (last >= opened) & known[last]
        hit = armed & ~record & known & (sha == sha[last]) & (t - t[last] < self.ttl)
        used, first = np.unique(last[hit], return_index=True)
        suppressed = np.zeros(len(t), bool)
        suppressed[np.flatnonzero(hit)[first]] = True
        kept = last[armed & np.append(opens[1:], True)]
        kept = kept[~np.isin(kept, used) & ((t[kept] + self.ttl) // 1000 + 1 > timerValues.getCurrentWatermarkInMs())]
        if n:
            self.handle.deleteTimer(self._ends(old[3]))
        if len(kept):
            self.held.update((np.stack([keys[kept], none[kept], sha[kept], t[kept]]).astype(np.int64).tobytes(),))
            self.handle.registerTimer(self._ends(t[kept]))
        else:
            self.held.clear()
        out = ~record & came
        yield pd.DataFrame({"event_id": ids[out], "key": pd.array(keys[out], "Int64"), "suppressed": suppressed[out]}).assign(key=lambda x: x["key"].mask(none[out]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())


#: How late an event may come unless the caller says otherwise, by the time it carries; what comes later is dropped, and counted by `watchdog.Health`.
LATE = "1 minute"


def live_bursts(stream: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """Events (key, ts, event_id) of a key less than `gap` apart as one, given out when the watermark has passed its end: key, start, n, last_id.

    `ordered.bursts` as a stream. The state holds a row for each burst that is still open; those stay there when the input ends.
    """
    w = F.session_window("ts", gap)
    merged = stream.withWatermark("ts", late).groupBy("key", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))
    return merged.select("key", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "last_id")


def live_echo(stream: DataFrame, ttl_seconds: float, late: str = LATE) -> DataFrame:
    """`ordered.echo` as a stream of (key, ts, event_id, kind, sha)."""
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    rows = stream.withWatermark("ts", late).select(
        "ts", "event_id", F.unix_micros("ts").alias("t"), whole("key"), F.col("key").isNull().alias("no_key"), whole("sha"), F.col("sha").isNotNull().alias("known"),
        F.coalesce(F.col("kind") == "record", F.lit(False)).alias("record"), F.pmod(F.xxhash64("key"), F.lit(SLOTS)).alias("slot"),
    )
    return rows.groupBy("slot").transformWithStateInPandas(EchoGuard(ttl_seconds), "event_id BIGINT, key BIGINT, suppressed BOOLEAN", "Append", "EventTime")


class ConflictBreaker(StatefulProcessor):
    """Admits an event while fewer than `threshold` admitted ones lie within the window; holds their times only, and none
    of a root once the watermark has passed the window."""

    def __init__(self, threshold: int, window_seconds: int):
        self.threshold, self.window = threshold, window_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "t BIGINT")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["t", "event_id"])
        held, admitted = [r[0] for r in self.held.get()] if self.held.exists() else [], []
        for now in found["t"].tolist():
            held = [t for t in held if now - t <= self.window * 1_000_000]
            admitted.append(self.threshold == 0 or len(held) < self.threshold)
            if admitted[-1] and self.threshold:
                held.append(now)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.held.put([(t,) for t in held])
            self.handle.registerTimer(held[-1] // 1000 + self.window * 1000 + 1)
        else:
            self.held.clear()
        yield pd.DataFrame({"event_id": found["event_id"].to_numpy(), "root": key[0], "admitted": admitted})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())


def live_breaker(stream: DataFrame, threshold: int, window_seconds: int, late: str = LATE) -> DataFrame:
    """`stream` has root, event_id and t, the time in microseconds."""
    guarded = stream.withColumn("ts", F.timestamp_micros("t")).withWatermark("ts", late).groupBy("root")
    return guarded.transformWithStateInPandas(ConflictBreaker(threshold, window_seconds), "event_id BIGINT, root BIGINT, admitted BOOLEAN", "Append", "EventTime")


def _settings(spark: SparkSession) -> dict[str, str]:
    """What a stream with keyed state is started with. A micro-batch opens every partition of the state, however few rows it has, so there are no
    more of them than tasks that run at once; and it writes what changed in them, not all that they hold. How many entries they hold is not
    counted: that costs a read ahead of every write, and nothing here asks for it."""
    slots = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(2, spark.sparkContext.defaultParallelism))
    store = "spark.sql.streaming.stateStore"
    return {
        f"{store}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        f"{store}.rocksdb.changelogCheckpointing.enabled": "true",
        f"{store}.rocksdb.trackTotalNumberOfRows": "false",
        "spark.sql.shuffle.partitions": str(slots),
    }


def drain(stream: DataFrame, spark: SparkSession, name: str, health: Health | None = None) -> DataFrame:
    """Run a stream to the end of its input and return what it wrote. `health` has then seen all of it, late rows included."""
    base = f"{shared_dir(spark)}/{name}"
    settings = _settings(spark)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    if health:
        spark.streams.addListener(health)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
        waited = time.monotonic() + 60
        while health and str(q.runId) not in health.ended and time.monotonic() < waited:
            time.sleep(0.05)
    finally:
        if health:
            spark.streams.removeListener(health)
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
