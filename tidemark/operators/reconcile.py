"""Comparing replicas: state by path, which side wins, what to do with a change."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import scalars as S


def states(local: DataFrame, server: DataFrame) -> DataFrame:
    """path, content_hash, size_bytes, server_hash, change_seq, state: one row for each local path."""
    s = server.select("path", F.col("fs_hash").alias("server_hash"), "change_seq")
    state = F.when(F.col("server_hash").isNull(), "missing-on-server").when(F.col("server_hash") == F.col("content_hash"), "match").otherwise("drift")
    return local.join(s, "path", "left").select("path", "content_hash", "size_bytes", "server_hash", "change_seq", state.alias("state"))


def with_shadow(rows: DataFrame, shadow: DataFrame) -> DataFrame:
    return rows.join(shadow.select("path", F.col("server_hash").alias("shadow_hash")), "path", "left")


def direction(state: Column, server: Column, shadow: Column) -> Column:
    """Drift is pushed only where the last-synced hash proves that the server has not moved."""
    return F.when(state == "drift", F.when(shadow == server, "push").otherwise("pull")).when(state == "missing-on-server", "push").otherwise("noop")


def decide(local_eq_server: Column, shadow_present: Column, shadow_eq_server: Column, local_eq_shadow: Column) -> Column:
    return (
        F.when(local_eq_server, "R1_noop").when(~shadow_present, "R5_conflict").when(shadow_eq_server, "R2_preserve_local")
        .when(local_eq_shadow, "R3_pull_clean").otherwise("R4_conflict")
    )


def decide_rows(rows: DataFrame) -> Column:
    """decide() over the columns of with_shadow(states())."""
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return decide(same("content_hash", "server_hash"), F.col("shadow_hash").isNotNull(), same("shadow_hash", "server_hash"), same("content_hash", "shadow_hash"))


def guard(decision: Column, strips_frontmatter: Column, same_body: Column) -> Column:
    """What a pull that would drop frontmatter becomes."""
    hit = strips_frontmatter & (decision.contains("pull_clean") | decision.contains("conflict"))
    return F.when(hit & same_body, "preserve_and_push").when(hit, "stash_then_align").otherwise("none")


def align(decision: Column, raw_equal: Column) -> Column:
    """A no-op whose bytes still differ is rewritten to the server's bytes, without a stash."""
    return F.when(decision.contains("noop") & ~raw_equal, "align").otherwise("keep")


def causal(decision: Column, incoming: Column, seq: Column, prov: Column) -> Column:
    """A conflict with a version not newer than the one adopted keeps the local bytes."""
    old = decision.contains("conflict") & (prov == "adopted") & (incoming <= seq)
    return F.when(F.coalesce(old, F.lit(False)), "preserve_local").otherwise(decision)


def mint(decision: Column, shadow_present: Column, suspect: Column, breaker_open: Column) -> Column:
    """What becomes of a conflict: skipped where the store or the breaker forbids it, else stashed and written."""
    return F.when(~decision.contains("conflict"), "not_conflict").when(~shadow_present & suspect, "skip_scope_suspect").when(breaker_open, "skip_breaker").otherwise("stash_and_write")


def pull_class(outcome: Column) -> Column:
    return F.when(outcome.isin("error", "integrity_failed"), "failed").when(outcome.isin("breaker_open", "local_edit_preserved", "guard_preserve_push_up", "shadow_scope_suspect"), "deferred").otherwise("succeeded")


#: Fixed value: paths of a kind that a report names.
SAMPLE_PATHS = 50


def _samples(rows: DataFrame, by: Sequence[str], lists: dict[str, Column], cap: int) -> DataFrame:
    """The `cap` first paths of each list by `by`, as arrays. The limit is taken in each partition before the shuffle, so no task collects
    more than `cap` paths of a partition and list."""
    kind = reduce(lambda w, kv: w.when(kv[1], kv[0]), lists.items(), F.when(F.lit(False), ""))
    first = Window.partitionBy(*by, "list").orderBy("path")
    held = rows.select(*by, "path", kind.alias("list")).filter("list IS NOT NULL").withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= cap)
    some = held.groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("list") == n, F.col("path")))).alias(n) for n in lists])
    return some


def report(rows: DataFrame, by: Sequence[str] = ("root",), cap: int = SAMPLE_PATHS) -> DataFrame:
    """The report of a pass over (path, direction, outcome) and the columns `by`, one row each.

    Every push is a modify, every pull that went through an add; a failed or deferred one is still divergent, and one of either makes the
    pass red. Deletes are always none. Outcomes count for pulls only; a pull without one was not executed, which is deferred.
    """
    push, pull = F.col("direction") == "push", F.col("direction") == "pull"
    what = F.when(pull, F.when(F.col("outcome").isNull(), "deferred").otherwise(pull_class(F.col("outcome"))))
    rows = rows.select(*by, "path", push.alias("push"), what.alias("class"))
    n = lambda c: F.count_if(F.col("class") == c)
    counts = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_scanned"), F.count_if("push").alias("modify_count"), n("succeeded").alias("add_count"), F.lit(0).cast("long").alias("delete_count"),
        F.count("class").alias("pulls_attempted"), n("succeeded").alias("pulls_succeeded"), n("failed").alias("pulls_failed"), n("deferred").alias("pulls_deferred"),
    )
    counts = counts.withColumn("files_in_sync", F.col("files_scanned") - F.col("modify_count")).withColumn("still_divergent", F.col("pulls_failed") + F.col("pulls_deferred"))
    counts = counts.withColumn("cycle_red", S.cycle_red(F.col("pulls_failed"), F.col("still_divergent"))).withColumn("soak_eligible", ~F.col("cycle_red"))
    lists = {"modify_sample": F.col("push"), "add_sample": F.col("class") == "succeeded", "unresolved_sample": F.col("class").isin("failed", "deferred")}
    some = _samples(rows, by, lists, cap).select(*[F.col(c).alias(f"of_{c}") for c in by], *lists)
    same = reduce(lambda a, b: a & b, [counts[c].eqNullSafe(some[f"of_{c}"]) for c in by])
    none = F.array().cast("array<string>")
    return counts.join(some, same, "left").select(*counts.columns, *[F.coalesce(c, none).alias(c) for c in lists])


def rollup(reports: DataFrame, order: str = "root") -> DataFrame:
    """One report of many: counts are added, samples are put on end in the order of the reports. Each report holds a bounded number of paths."""
    total = [F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("files_scanned", "files_in_sync", "modify_count", "add_count", "delete_count")]
    ends = [F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(c).alias("s")))), lambda x: x["s"])).alias(c) for c in ("modify_sample", "add_sample")]
    return reports.agg(F.count(F.lit(1)).alias("roots"), *total, *ends)


def stash_decision(path: Column, policy: Column, local_lsn: Column, server_lsn: Column) -> Column:
    older = local_lsn.isNull() | (local_lsn < server_lsn)
    return (P.sensitivity_class(path) == "D") | policy.isin("server_wins", "manual") | older


def backfill(server: DataFrame, local: DataFrame) -> DataFrame:
    """Server rows without a local file, on safe paths that no rule keeps back."""
    return server.join(local.select("path"), "path", "left_anti").filter(P.is_safe(F.col("path")) & P.substrate_rule(F.col("path")).isNull())


def seed_shadow(rows: DataFrame, shadow: DataFrame) -> DataFrame:
    """The matches as first baseline, if there is none yet."""
    some = shadow.select(F.lit(1).alias("one")).limit(1)
    return rows.filter("state = 'match'").select("path", "server_hash").join(some, F.lit(True), "left_anti")


def bodies(events: DataFrame, notes: DataFrame) -> DataFrame:
    """Notifications with the note they speak of; found is false where it is gone."""
    return events.join(notes, "path", "left").withColumn("found", F.col("fs_hash").isNotNull())


def deletes(events: DataFrame, shadow: DataFrame, local: DataFrame) -> DataFrame:
    """Deletes, and whether local bytes that differ from the baseline are stashed first."""
    s, l = shadow.select("path", F.col("server_hash").alias("shadow_hash")), local.select("path", "content_hash", "size_bytes")
    rows = events.join(s, "path", "left").join(l, "path", "left")
    keep = (F.col("shadow_hash").isNotNull() & (F.col("size_bytes") > 0) & (F.col("content_hash") != F.col("shadow_hash")))
    outcome = F.when(F.col("content_hash").isNull(), "noop_absent").when(keep, "stash_then_delete").otherwise("delete")
    return rows.withColumn("outcome", outcome)


def push_entries(pushes: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, size_bytes, content_hash and base_hash of the changes (path, state, server_hash) to push; their bodies are read when sent.

    The base is the server's hash where the replicas drift, else '' (no row). A change that the manifest does not know has an
    `error` and no hash.
    """
    base = F.when(F.col("state") == "drift", F.col("server_hash")).otherwise("")
    rows = pushes.select("path", "state", "server_hash").join(manifest.select("path", "size_bytes", "content_hash"), "path", "left")
    lost = F.when(F.col("content_hash").isNull(), "delta path not in local manifest")
    return rows.select("path", "size_bytes", "content_hash", F.when(lost.isNull(), base).alias("base_hash"), lost.alias("error"))


def declared_bases(pushes: DataFrame, shadow: DataFrame, base_seq: DataFrame) -> DataFrame:
    """`pushes` (path, base_hash) with base, base_kind and lineage: an unknown base takes the last-synced hash (shadow: path, server_hash), the others
    stay as they are; lineage is the sequence of what lies there (base_seq: path, seq), null where none is known."""
    s, q = shadow.select("path", F.col("server_hash").alias("synced")), base_seq.select("path", F.col("seq").alias("lineage"))
    b = F.col("base_hash")
    rows = pushes.join(s, "path", "left").join(q, "path", "left")
    return rows.select(*[pushes[c] for c in pushes.columns], F.coalesce(b, "synced").alias("base"), S.base_kind(b).alias("base_kind"), "lineage")


def folders(paths: DataFrame, marker: str) -> DataFrame:
    """First folders of `path` but those that start with a dot, and whether they hold `marker`."""
    f = F.split_part("path", F.lit("/"), F.lit(1))
    rows = paths.filter(F.contains("path", F.lit("/")) & ~F.startswith("path", F.lit(".")) & (f != ""))
    return rows.groupBy(f.alias("folder")).agg(F.bool_or(F.split_part("path", F.lit("/"), F.lit(2)) == marker).alias("has_app"))


def unseen_stashes(wanted: DataFrame, held: DataFrame, *same: str) -> tuple[DataFrame, DataFrame]:
    """`wanted` split by whether a stash of the same bytes lies there already (`held`, equal in `same`): those that are there, and those to write."""
    return wanted.join(held.select(*same), [*same], "left_semi"), wanted.join(held.select(*same), [*same], "left_anti")


def compare_and_set(rows: DataFrame, expected: Column, strips: Column) -> DataFrame:
    """Outcome of rewriting a file to the server's bytes only if it is still what was seen."""
    out = F.when(F.col("content_hash").isNull(), "skip_missing").when(F.col("content_hash") != expected, "skip_concurrent_edit").when(strips, "skip_frontmatter_strip").otherwise("written")
    return rows.withColumn("outcome", out)


def upsert(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """`store` with the rows of `fresh` in place of those of the same key; `fresh` has one row a key."""
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def push_events(events: DataFrame, device: str) -> DataFrame:
    """event_id, path, action, content_sha, base, queued_at, device of file events (event_id, kind, path, new_path, content, queued_at).

    A rename is a create at the new path; the bytes are hashed, not kept. Missing content gives no row, but a delete needs none.
    """
    kind, gone = F.col("kind"), F.col("kind") == "deleted"
    action = F.when(gone, "delete").when(kind == "modified", "modify").when(kind.isin("created", "renamed"), "create")
    rows = events.withColumn("action", action).filter(F.col("action").isNotNull() & (gone | F.col("content").isNotNull()))
    sha = F.when(gone, "").otherwise(F.sha2(F.col("content").cast("binary"), 256))
    path = F.when(kind == "renamed", F.col("new_path")).otherwise(F.col("path"))
    return rows.select("event_id", path.alias("path"), "action", sha.alias("content_sha"), F.lit(None).cast("string").alias("base_hash"), "queued_at", F.lit(device).alias("device_id"))


def preserve_bytes(pushed: DataFrame, files: DataFrame) -> DataFrame:
    """stash: the pushed bytes (path, content_sha) lie nowhere else, as the file (path, content_hash) differs or is gone."""
    there = files.select("path", "content_hash")
    return pushed.join(there, "path", "left").withColumn("stash", ~F.col("content_hash").eqNullSafe(F.col("content_sha"))).drop("content_hash")


def drain_progress(outcomes: DataFrame, pending: DataFrame, by: str) -> DataFrame:
    """synced, progress and skipped of each drain: what was taken stamps a sync, any outcome or an empty journal is progress."""
    o = outcomes.groupBy(by).agg(F.bool_or(F.col("outcome").isin("sent", "merged")).alias("synced"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "skipped").alias("skipped"))
    rows = pending.select(by, "pending").join(o, by, "full")
    progress = (F.coalesce("n", F.lit(0)) > 0) | (F.coalesce("pending", F.lit(0)) == 0)
    return rows.select(by, F.coalesce("synced", F.lit(False)).alias("synced"), progress.alias("progress"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def after_conflict(found: Column, action: Column, receipt: Column) -> Column:
    """What follows a refused push once the note is fetched again: gone, the stores forget it and a delete is accepted while
    other bytes are created anew; there, it is merged, with a read receipt where its hash was verified."""
    gone = F.when(action == "delete", "accept_delete").otherwise("recreate_no_row")
    return F.when(~found, gone).when(receipt.isNotNull(), "receipt_and_merge").otherwise("merge")


def stash_positions(rows: DataFrame, base_seq: DataFrame) -> DataFrame:
    """lsn: the sequence under which local bytes are stashed before a delete; 0 where none is known."""
    return rows.join(base_seq.select("path", "seq"), "path", "left").withColumn("lsn", F.coalesce("seq", F.lit(0).cast("long"))).drop("seq")
