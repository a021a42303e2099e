"""Sequential loops as windows: latest rows, guards, streaks, running totals."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.functions.bind import bind
from tidemark.plans.staging import stage

T_ZERO = "2000-01-01 00:00:00"
#: Fixed value: bytes of an error that a ledger keeps.
ERROR_BYTES = 512


def compact(journal: DataFrame) -> DataFrame:
    """The last line of every path."""
    last = Window.partitionBy("path").orderBy(F.desc("line_no"))
    return journal.withColumn("rn", F.row_number().over(last)).filter("rn = 1").drop("rn")


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum of `value` in the order of any column, without one task that reads all rows.

    Ranges of the order are summed side by side; the totals of earlier ranges, one row a range, are added.
    """
    cut = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("range", F.spark_partition_id())
    cut = stage(cut, "running-total")
    totals = cut.groupBy("range").agg(F.sum(value).alias("total"))
    ahead = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("ahead"))
    inside = F.sum(value).over(Window.partitionBy("range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("inside", inside).join(ahead, "range").withColumn(name, F.col("inside") + F.col("ahead")).drop("range", "inside", "ahead")


def chains(journal: DataFrame, size: int = 32) -> DataFrame:
    """The journal (line_no, path, action) drained in batches of `size` lines: batch, path, n and the actions of a path in order; a list holds `size` at most."""
    ranked = running_total(journal.withColumn("one", F.lit(1).cast("long")), "line_no", "one", "rank")
    chain = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "action"))), lambda x: x["action"]), ">")
    batched = ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long"))
    return batched.groupBy("batch", "path").agg(F.count(F.lit(1)).alias("n"), chain.alias("chain"))


def append_within(rows: DataFrame, held: int, cap: int) -> DataFrame:
    """Rows with whether they still fit under the cap; sizes are positive, so those that fit are a prefix."""
    total = running_total(rows, "line_no", "line_bytes", "run_bytes")
    return total.withColumn("fits", F.col("run_bytes") + held <= cap)


def numbered(rows: DataFrame, key: str, order: Sequence[str], counts: dict[str, Column]) -> DataFrame:
    """`rows` with running counts by `key` in the order of `order`, and the range that a row lies in; null keys are a key.

    `counts` names conditions: how many rows up to each one fulfil them. One key may hold all rows: ranges of the
    order are counted side by side, and the counts of earlier ranges, one row a range and key, are added.
    """
    by = [key, *order]
    cut = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    cut = stage(cut.select("*", *[F.coalesce(c, F.lit(False)).cast("long").alias(f"is_{n}") for n, c in counts.items()]), "numbered")
    sums = cut.groupBy("range", F.col(key).alias("of")).agg(*[F.sum(f"is_{n}").alias(f"sum_{n}") for n in counts])
    earlier = Window.partitionBy("of").orderBy("range")
    sums = sums.select(F.col("range").alias("in"), "of", *[(F.sum(f"sum_{n}").over(earlier) - F.col(f"sum_{n}")).alias(f"ahead_{n}") for n in counts])
    own = Window.partitionBy("range", key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    inside = cut.select("*", *[F.sum(f"is_{n}").over(own).alias(f"inside_{n}") for n in counts])
    joined = inside.join(sums, (F.col("range") == F.col("in")) & F.col(key).eqNullSafe(F.col("of")))
    return joined.select(*rows.columns, "range", "at", *[(F.col(f"inside_{n}") + F.col(f"ahead_{n}")).alias(n) for n in counts])


def ranged(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """`rows` in ranges of (key, *order), written: range, and at, which rises in that order within a range."""
    by = [key, *order]
    return stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "ranged")


def carried(cut: DataFrame, key: str, values: dict[str, Column], before: bool = False) -> DataFrame:
    """The last value of each of `values` that is not null, at or before a row of its key (`before`: only before it), null if there is none.

    `cut` has range and at, as `ranged` and `numbered` give them. One key may hold all rows: each range looks among its own rows, and takes
    what the ranges ahead of it leave, one row a range and key. Null keys are a key.
    """
    left = [F.max(F.when(c.isNotNull(), F.struct("at", c.alias("v")))).alias(f"left_{n}") for n, c in values.items()]
    left = cut.groupBy(F.col("range").alias("in"), F.col(key).alias("of")).agg(*left)
    earlier = Window.partitionBy("of").orderBy("in").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select("in", "of", *[F.last(f"left_{n}", True).over(earlier)["v"].alias(f"ahead_{n}") for n in values])
    own = Window.partitionBy("range", key).orderBy("at").rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    inside = cut.select("*", *[F.last(c, True).over(own).alias(f"inside_{n}") for n, c in values.items()])
    joined = inside.join(left, (F.col("range") == F.col("in")) & F.col(key).eqNullSafe(F.col("of")))
    return joined.select(*cut.columns, *[F.coalesce(f"inside_{n}", f"ahead_{n}").alias(n) for n in values])


def _spread(first: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`first` (one row for each of `keys`) once for each range that has such rows, so that joins on range and keys have no hot key."""
    held = rows.select("range", *keys).distinct()
    same = reduce(lambda a, b: a & b, [held[k].eqNullSafe(first[k]) for k in keys])
    return held.join(first, same).select(held["range"], *[held[k] for k in keys], *[first[c] for c in first.columns if c not in keys])


def delete_burst(events: DataFrame, threshold: int, window: str) -> DataFrame:
    """The valve of deletes, by root in order of (ts, event_id); resets open a new epoch.

    For a delete, tripped: it is the first at which `threshold` deletes of its epoch lie within the window (edge excluded); paused: the
    latch before it. For a reset, paused: whether it found the valve shut. A window of zero never trips; a threshold of
    zero trips like one. No task needs all rows of a root: which delete lies `threshold` - 1 back is a join on numbers, and
    the first trip of an epoch a minimum.
    """
    e = numbered(events, "root", ["ts", "event_id"], {"epoch": F.col("is_reset"), "nth": ~F.col("is_reset")})
    e = stage(e, "valve")
    width = F.expr(f"INTERVAL {window}")
    deletes = e.filter("NOT is_reset")
    at = F.lit(T_ZERO).cast("timestamp_ntz")
    if events.sparkSession.range(1).select(at + width == at).first()[0]:
        hits = deletes.filter("false")
    elif threshold <= 1:
        hits = deletes
    else:
        back = deletes.select(F.col("root").alias("r"), F.col("epoch").alias("p"), (F.col("nth") + threshold - 1).alias("k"), F.col("ts").alias("from"))
        near = deletes["root"].eqNullSafe(F.col("r")) & (F.col("epoch") == F.col("p")) & (F.col("nth") == F.col("k"))
        hits = deletes.join(back, near).filter(F.col("from") > F.col("ts") - width)
    trips = stage(hits.groupBy("root", "epoch").agg(F.min("nth").alias("trip")), "trips")
    here = _spread(trips, deletes, ["root", "epoch"]).select(F.col("range").alias("g"), F.col("root").alias("r"), F.col("epoch").alias("p"), "trip")
    there = _spread(trips.withColumn("epoch", F.col("epoch") + 1), e.filter("is_reset"), ["root", "epoch"]).select(F.col("range").alias("g"), F.col("root").alias("r"), F.col("epoch").alias("p"), F.lit(0).cast("long").alias("trip"))
    # a reset looks at the epoch that it ends, a delete at its own
    marks = here.withColumn("w", F.lit(False)).union(there.withColumn("w", F.lit(True)))
    joined = e.join(marks, (F.col("range") == F.col("g")) & e["root"].eqNullSafe(F.col("r")) & (F.col("epoch") == F.col("p")) & (F.col("is_reset") == F.col("w")), "left")
    paused = F.when(F.col("is_reset"), F.col("trip").isNotNull()).otherwise(F.coalesce(F.col("nth") > F.col("trip"), F.lit(False)))
    return joined.select(*events.columns, paused.alias("paused"), (~F.col("is_reset") & F.coalesce(F.col("nth") == F.col("trip"), F.lit(False))).alias("tripped"))


def classify(events: DataFrame, threshold: int, window: str, **gates) -> DataFrame:
    """decision, rule and side of each file event (root, ts, event_id, kind, path, new_path), in order by root.

    Creates and modifies pass the gates of write_filter (`gates` are its arguments), renames those of both paths (the first that fails
    names its side and nothing else is looked at; a burst does not stop them), deletes the gates and then the valve, which counts deletes that
    were allowed only. The delete that trips is still allowed. A reset opens the valve: "resumed" if it was shut, else "not_paused".
    """
    old, new = P.write_filter(F.col("path"), **gates), P.write_filter(F.col("new_path"), **gates)
    e = bind(events, "old", F.when(F.col("kind") != "reset", old))
    e = bind(e, "new", F.when((F.col("kind") == "rename") & (F.col("old.decision") == "allow"), new))
    failed = F.coalesce(F.col("new.decision"), F.lit("allow")) != "allow"
    e = e.select(
        *events.columns, F.when(failed, F.col("new.decision")).otherwise(F.col("old.decision")).alias("decision"), F.when(failed, F.col("new.rule")).otherwise(F.col("old.rule")).alias("rule"),
        F.when(failed, "new").when(F.col("old.decision") != "allow", "old").alias("side"),
    )
    e = stage(e, "gated")
    valve = F.coalesce((F.col("kind") == "reset") | (F.col("kind") == "delete") & (F.col("decision") == "allow"), F.lit(False))
    seen = delete_burst(e.filter(valve).withColumn("is_reset", F.col("kind") == "reset"), threshold, window)
    answer = F.when(F.col("is_reset"), F.when(F.col("paused"), "resumed").otherwise("not_paused")).when(F.col("paused"), "drop_delete_burst").otherwise(F.col("decision"))
    return seen.withColumn("decision", answer).select(*e.columns).union(e.filter(~valve).select(*e.columns))


def drop_counts(classified: DataFrame, *by: str) -> DataFrame:
    """Dropped events by reason, and in all: scope counts as an exclude, and what only the valve stops has no counter of its own."""
    n = lambda *d: F.count_if(F.col("decision").isin(*d))
    every = ("drop_substrate", "drop_extension", "drop_exclude", "drop_out_of_scope")
    return classified.groupBy(*by).agg(
        n(every[0]).alias("dropped_substrate"), n(every[1]).alias("dropped_extension"), n(*every[2:]).alias("dropped_excludes"), n(*every, "drop_delete_burst").alias("filtered"))


def echo(events: DataFrame, ttl: str) -> DataFrame:
    """suppressed: the latest record before a probe has its hash, is younger than the TTL, and no probe used it yet.

    A record is used by its first hit, so a hit counts if the hit before it was of another record. No task needs all rows of a key.
    """
    rec = F.struct("range", "at", "ts", "sha")
    e = carried(ranged(events, "key", ["ts", "event_id"]), "key", {"rec": F.when(F.col("kind") == "record", rec)}, before=True).filter("kind = 'probe'")
    hit = (F.col("rec.sha") == F.col("sha")) & (F.col("ts") < F.col("rec.ts") + F.expr(f"INTERVAL {ttl}"))
    used = F.struct("rec.range", "rec.at")
    e = carried(e.withColumn("hit", F.coalesce(hit, F.lit(False))), "key", {"used": F.when(F.col("hit"), used)}, before=True)
    return e.select("event_id", "key", (F.col("hit") & ~used.eqNullSafe(F.col("used"))).alias("suppressed"))


def enqueue(events: DataFrame) -> DataFrame:
    """dup: same hash as the last one enqueued for the path since its last delete, and same as the baseline (`shadow_hash`)."""
    by = Window.partitionBy("path").orderBy("line_no")
    e = events.withColumn("epoch", F.sum((F.col("action") == "delete").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0))).filter("action <> 'delete'")
    own = Window.partitionBy("path", "epoch").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.last(F.when(F.col("append_ok"), F.col("content_sha")), True).over(own)
    same = (seen == F.col("content_sha")) & (F.col("shadow_hash") == F.col("content_sha"))
    return e.withColumn("last_enqueued", seen).withColumn("dup", F.coalesce(same, F.lit(False)))


def unsupported_action(n: Column, quiet: int = 12) -> Column:
    return F.when(n == 1, "once").when(n <= quiet, "quiet").otherwise("escalate")


def heartbeat_streaks(beats: DataFrame) -> DataFrame:
    """The n-th 405 since the last 200 and what is logged for it; other answers neither count nor reset."""
    by = Window.partitionBy("device").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = beats.withColumn("epoch", F.sum((F.col("status") == 200).cast("int")).over(by)).filter("status = 405")
    n = F.row_number().over(Window.partitionBy("device", "epoch").orderBy("ts", "event_id"))
    return e.withColumn("n", n.cast("long")).withColumn("action", unsupported_action(F.col("n")))


def retry_ledger(attempts: DataFrame) -> DataFrame:
    """Stuck paths: failures since the last clear, their first and last time, and the last error."""
    by = Window.partitionBy("path").orderBy("line_no")
    e = attempts.withColumn("epoch", F.sum(F.col("is_clear").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    e = e.withColumn("last_epoch", F.max("epoch").over(Window.partitionBy("path"))).filter("epoch = last_epoch AND NOT is_clear")
    return e.groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.min("ts").alias("first_failed"), F.max("ts").alias("last_attempt"), F.max_by("error", "line_no").alias("last_error")).withColumn("last_error", S.truncated(F.col("last_error"), ERROR_BYTES))


def free_suffix(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """A free name for each wanted copy (base, ord): the base itself, else the first numbers from 2 that are not taken.

    The k-th copy gets the k-th free slot: k and as many more as taken slots come before it. A taken slot t that is the i-th of its base has t - i free
    ones before it, so copies and taken slots are merged in one order and counted range by range; a base may hold all rows.
    """
    w = numbered(wanted.select("base", "ord"), "base", ["ord"], {"k": F.lit(True)})
    t = numbered(taken.select("base", F.col("slot").cast("long").alias("slot")).filter("slot >= 1").distinct(), "base", ["slot"], {"i": F.lit(True)})
    copies = w.select("base", F.col("k").alias("place"), F.lit(1).alias("copy"), "ord")
    marks = copies.unionByName(t.select("base", (F.col("slot") - F.col("i") + 1).alias("place"), F.lit(0).alias("copy")), allowMissingColumns=True)
    slots = numbered(marks, "base", ["place", "copy", "ord"], {"ahead": F.col("copy") == 0}).filter("copy = 1").withColumn("slot", (F.col("place") + F.col("ahead")).cast("int"))
    name = F.when(F.col("slot") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("slot").cast("string")))
    return slots.select("base", "ord", "slot", name.alias("name"))


def islands(rows: DataFrame, key: str, time: str, width: int) -> DataFrame:
    """`rows` with `island`: numbers of groups of a key's rows that are more than `width` apart from each other.

    Times are cut into slices of that width; where one slice is empty, the rows on its two sides are further apart. Only
    the table of slices that hold rows is put in order.
    """
    cut = rows.withColumn("slice", F.floor(F.col(time) / width))
    held = cut.select(key, "slice").distinct()
    by = Window.partitionBy(key).orderBy("slice")
    new = F.coalesce((F.col("slice") - F.lag("slice").over(by) > 1).cast("int"), F.lit(0))
    held = held.withColumn("new", new).withColumn("island", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")
    return cut.join(held.withColumnRenamed(key, "of"), F.col(key).eqNullSafe(F.col("of")) & (cut["slice"] == held["slice"])).select(*rows.columns, "island")


def admission(events: DataFrame, threshold: int, window_seconds: int) -> DataFrame:
    """Conflict breaker by root: an event is admitted while fewer than `threshold` admitted ones lie within the window.

    Whether one is admitted hangs on those before it, so no window function says it: sorted rows stream by, and a task
    holds the last `threshold` admitted times of one root. Roots are cut where more than the window lies between two
    events: nothing is held there, so both sides go to tasks of their own.
    """
    micros = window_seconds * 1_000_000
    rows = events.select("root", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    rows = islands(rows, "root", "t", micros).repartition("root", "island").sortWithinPartitions("root", "island", "t", "event_id")

    def run(batches):
        at, held = None, deque()
        for batch in batches:
            keys = zip(batch.column("root").to_pylist(), batch.column("island").to_pylist())
            out = []
            for key, t in zip(keys, batch.column("t").to_pylist()):
                if key != at:
                    at, held = key, deque()
                while held and t - held[0] > micros:
                    held.popleft()
                ok = threshold == 0 or len(held) < threshold
                if ok and threshold:
                    held.append(t)
                out.append(ok)
            yield pa.RecordBatch.from_arrays([batch.column("root"), batch.column("event_id"), pa.array(out, pa.bool_())], ["root", "event_id", "admitted"])

    return rows.mapInArrow(run, "root long, event_id long, admitted boolean")


def capacity_streak(appends: DataFrame, limit: int) -> DataFrame:
    """tripped: the `limit`-th failure for capacity in a row; fenced: latched from then on. By root, none of which needs a task of its own."""
    failed = F.coalesce(F.col("is_cap"), F.lit(False))
    e = stage(numbered(appends, "root", ["ts", "event_id"], {"caps": failed}), "streak")
    e = carried(e, "root", {"base": F.when(~failed, F.col("caps"))})
    e = e.withColumn("hit", failed & (F.col("caps") - F.coalesce("base", F.lit(0)) == limit))
    e = carried(e, "root", {"shut": F.when(F.col("hit"), F.lit(True))}, before=True)
    shut = F.coalesce("shut", F.lit(False))
    return e.select(*appends.columns, (F.col("hit") & ~shut).alias("tripped"), (F.col("hit") | shut).alias("fenced"))


def idle_seconds(rows: DataFrame) -> DataFrame:
    """Seconds since the last stamp at or before each row, by root; null before the first."""
    e = carried(ranged(rows, "root", ["ts", "event_id"]), "root", {"stamp": F.when(F.col("is_progress"), F.col("ts"))})
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select(*rows.columns, F.floor((micros("ts") - micros("stamp")) / 1_000_000).alias("idle"))


def recovery(rows: DataFrame, limit: int, threshold: int = S.STALL_SECONDS, alive_threshold: int = S.ALIVE_SECONDS) -> DataFrame:
    """pending, idle, silent, fenced and the trigger (see scalars.recovery_trigger) at each row, by root in order of (ts, event_id).

    Kinds: queued (one more waits), sent (one less, and progress), alive (a sign of the watcher), full (a refused append; `limit`
    in a row fence for good). Idle counts from the first row of a root until something was sent; silent is null before the first sign.
    """
    is_ = lambda k: F.col("kind").eqNullSafe(F.lit(k))
    e = stage(numbered(rows, "root", ["ts", "event_id"], {"nth": F.lit(True), "queued": is_("queued"), "sent": is_("sent"), "full": is_("full")}), "health")
    stamps = {"start": F.when(F.col("nth") == 1, F.col("ts")), "went": F.when(is_("sent"), F.col("ts")), "sign": F.when(is_("alive"), F.col("ts")), "base": F.when(~is_("full"), F.col("full"))}
    e = carried(e, "root", stamps)
    hit = is_("full") & (F.col("full") - F.coalesce("base", F.lit(0)) == limit)
    e = carried(e.withColumn("hit", hit), "root", {"shut": F.when(F.col("hit"), F.lit(True))})
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    since = lambda c: F.floor((micros(F.col("ts")) - micros(c)) / 1_000_000)
    e = e.select(
        *rows.columns, (F.col("queued") - F.col("sent")).alias("pending"), since(F.coalesce("went", "start")).alias("idle"), since(F.col("sign")).alias("silent"),
        F.coalesce("shut", F.lit(False)).alias("fenced"))
    return e.withColumn("trigger", S.recovery_trigger(F.col("pending"), F.col("idle"), F.col("fenced"), F.col("silent"), threshold, alive_threshold))


def backoff(n: Column, initial: int, most: int) -> Column:
    """min(initial * 2**n, most), safe for any n."""
    return F.least(F.lit(initial).cast("long") * F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(40)).cast("int")), F.lit(most).cast("long"))


def bursts(events: DataFrame, gap: str) -> DataFrame:
    """Events of a key less than `gap` apart as one. The reference's debounce is a third-party crate, so this is an approximation."""
    return events.groupBy("key", F.session_window(F.col("ts").cast("timestamp"), gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).select("key", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "last_id")


def cooldown(rows: DataFrame, seconds: int) -> DataFrame:
    """held: the last arming before a row, by root, is less than `seconds` old."""
    e = carried(ranged(rows, "root", ["ts", "event_id"]), "root", {"armed": F.when(F.col("arm"), F.col("ts"))}, before=True)
    return e.select(*rows.columns, F.coalesce(F.col("ts") < F.col("armed") + F.expr(f"INTERVAL {seconds} SECONDS"), F.lit(False)).alias("held"))


def last_state(sets: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value that each key was set to last."""
    return sets.groupBy(key).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
