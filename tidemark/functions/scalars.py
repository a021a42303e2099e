"""Small functions of envelopes, settings, times and status lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.paths import head_bytes


#: Seconds without progress, and without a sign of the watcher, after which a run is recovered.
STALL_SECONDS, ALIVE_SECONDS = 900, 300


def _field(body: Column, name: str) -> tuple[Column, Column]:
    """Kind and text of a field of a JSON object; both null where it is missing or the text is none."""
    found = F.call_function("variant_get", F.call_function("try_parse_json", body), F.lit(f"$.{name}"))
    return F.call_function("schema_of_variant", found), F.call_function("try_variant_get", found, F.lit("$"), F.lit("string"))


def seq_of(body: Column) -> Column:
    """A feed position given as a whole number or as digits in a string; 0 for anything else, signs of less and spaces too.
    Positions beyond a signed 64-bit number are 0."""
    kind, value = _field(body, "lsn")
    whole = (kind == "BIGINT") & ~F.startswith(value, F.lit("-")) | (kind == "STRING") & F.rlike(value, F.lit("\\A\\+?[0-9]+\\z"))
    return F.coalesce(F.when(whole, value.try_cast("bigint")), F.lit(0).cast("long"))


def op_of(body: Column) -> Column:
    """A missing operation is an upsert; null where it is no string (an explicit null included), or the body no JSON: such messages are refused."""
    kind, value = _field(body, "op")
    return F.when(F.call_function("try_parse_json", body).isNotNull(), F.when(kind.isNull(), F.lit("UPSERT")).when(kind == "STRING", value))


def legacy_id(*parts: str | Column) -> Column:
    """`legacy-` and 16 hex digits that equal entries share. The digits are of another hash than the original's, which is not published."""
    return F.concat(F.lit("legacy-"), F.left(F.sha2(F.concat_ws("\x1f", *parts), 256), F.lit(16)))


def new_event_id(nanos: Column, n: Column) -> Column:
    """The time in nanoseconds and a counter."""
    return F.concat_ws("-", nanos.cast("string"), n.cast("string"))


def is_finished(event_type: Column) -> Column:
    """The phase gate of the feed; an unknown or null kind does not pass."""
    return event_type.eqNullSafe(F.lit("enrichment_complete"))


def response_outcome(status: Column, answer: Column) -> Column:
    """Outcome of a push by HTTP status and, where it went through, by the answer in the body; all that is not known is retried."""
    fine = F.when(answer == "accepted", "sent").when(answer == "merged", "merged").when(answer == "conflict_markers", "conflict_markers").otherwise("network_exhausted")
    return (
        F.when(status.isin(200, 201), fine).when(status == 409, "conflict_unrecoverable").when(status == 401, "unauthorized").when(status == 403, "forbidden")
        .when(status == 426, "upgrade_required").when(status.isin(400, 422), "skipped").otherwise("network_exhausted")
    )


def is_acked(outcome: Column) -> Column:
    """Whether an outcome takes its line out of the journal; an unknown one does not."""
    return F.coalesce(outcome.isin("sent", "merged", "conflict_markers", "skipped", "unauthorized", "forbidden", "conflict_unrecoverable"), F.lit(False))


def recovery_trigger(pending: Column, idle: Column, fenced: Column, silent: Column, threshold: int = STALL_SECONDS, alive_threshold: int = ALIVE_SECONDS) -> Column:
    """The first reason to recover, null without one: entries wait and none went for `threshold` seconds; the watcher is fenced; it gave no
    sign for `alive_threshold` seconds. Times that are null count as 0: what never started is not late."""
    stalled = (F.coalesce(pending, F.lit(0)) > 0) & (F.coalesce(idle, F.lit(0)) >= threshold)
    return F.when(stalled, "push_stall").when(fenced, "watcher_fenced").when(F.coalesce(silent, F.lit(0)) >= alive_threshold, "watcher_stale")


def base_kind(base: Column) -> Column:
    """What a declared base says: unknown (null), no_row ('') or known."""
    return F.when(base.isNull(), "unknown").when(base == "", "no_row").otherwise("known")


def single_append(line_bytes: Column, held: Column | int, cap: int) -> Column:
    """A single append that would pass the cap is an error and writes nothing, unlike a batch, which keeps what fits."""
    return F.when(line_bytes + held > cap, "error_over_cap").otherwise("ok")


def materialize_back(accepted: Column, action: Column, drained: Column, canonical: Column, server: Column) -> Column:
    """What follows a push by the server's hash: none where it was not accepted, deletes, or has no hash or the one that was sent; the
    canonical form where that has the hash; else a fetch. `drained` and `canonical` are hashes."""
    same = ~F.coalesce(accepted, F.lit(False)) | action.eqNullSafe(F.lit("delete")) | server.isNull() | server.eqNullSafe(drained)
    return F.when(same, "none").when(canonical == server, "align_form_c").otherwise("fetch")


def ack_hash(answer: Column, server: Column, content: Column, local: Column) -> Column:
    """The baseline after an answer: the first hash known where the server took the bytes, else none."""
    return F.when(answer.isin("accepted", "merged"), F.coalesce(server, content, local))


def platform_name(os: Column, arch: Column) -> Column:
    name = F.concat_ws("-", os, arch)
    return F.when(name.isin("windows-x86_64", "macos-x86_64", "macos-aarch64", "linux-x86_64", "linux-aarch64"), name).otherwise("unknown")


def user_agent(product: Column, version: Column, platform: Column) -> Column:
    return F.concat_ws("/", product, version, platform)


def heartbeat_body(version: Column, platform: Column, last_seen: Column, last_sync: Column) -> Column:
    """A JSON object; a sync that is not known is left out, never null."""
    return F.to_json(F.struct(version.alias("daemon_version"), platform.alias("daemon_platform"), last_seen.alias("last_seen"), last_sync.alias("last_sync")))


def subscriber_id(own: Column, fallback: Column) -> Column:
    """A root's own subscriber, the common one where it has none."""
    return F.coalesce(F.nullif(own, F.lit("")), fallback)


def cycle_red(pulls_failed: Column, still_divergent: Column) -> Column:
    """Whether a pass left something undone; its negation makes the pass count towards convergence. Null counts are 0."""
    return (F.coalesce(pulls_failed, F.lit(0)) > 0) | (F.coalesce(still_divergent, F.lit(0)) > 0)


def restart_now(staged: Column, staged_for: Column, idle_for: Column, uploads: Column, verifying: Column, reconciling: Column, quiet: int, longest: int) -> Column:
    """Restart into a staged update: at once after `longest` seconds, else when nothing runs and all was quiet for `quiet`
    seconds; an activity never seen (null) is quiet."""
    busy = (uploads > 0) | verifying | reconciling
    return F.when(~staged, False).when(staged_for >= longest, True).when(busy, False).otherwise(F.coalesce(idle_for >= quiet, F.lit(True)))


def launch(configured: Column, token: Column) -> Column:
    """(start_sync, show_wizard)"""
    return F.struct(configured.alias("start_sync"), (~(configured & token)).alias("show_wizard"))


def plugin_policy(managed: Column) -> Column:
    return F.struct(*[(~managed).alias(c) for c in ("single_instance", "updater", "autostart", "allow_wizard")])


def truncated(s: Column, n: int) -> Column:
    return F.when(F.octet_length(s) <= n, s).otherwise(F.concat(head_bytes(s, n), F.lit("...")))


def staleness(seconds: Column) -> Column:
    s = seconds.cast("long")
    whole = lambda k: F.floor(s / k).cast("string")
    return (
        F.when(s < 60, F.concat(s.cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(s < 86_400, F.concat(whole(3600), F.lit("h ago"))).otherwise(F.concat(whole(86_400), F.lit("d ago")))
    )


def positive_or(text: Column, default: int) -> Column:
    """A positive whole number, else the default."""
    return F.coalesce(F.nullif(F.greatest(text.try_cast("bigint"), F.lit(0).cast("long")), F.lit(0).cast("long")), F.lit(default).cast("long"))


def receipt(body: Column, declared: Column, head: Column, seq: Column) -> Column:
    """The body's hash if it is the declared one, agrees with the head where one is known, and has a sequence."""
    actual = F.sha2(body, 256)
    return F.when(seq.isNotNull() & (actual == declared) & (head.isNull() | (actual == head)), actual)


def tooltip(redflag, verifying, broken, error, integrity, conflicts, paused, pending, received, sent, idle) -> Column:
    """One line of status: the first of stop flag, check, outage, issues, uploads, rest."""
    text = lambda c: c.cast("string")
    # fixed values: the wording of each line
    parts = F.concat_ws(
        " / ", F.when(integrity > 0, F.concat(text(integrity), F.lit(" integrity"))), F.when(conflicts > 0, F.concat(text(conflicts), F.lit(" conflicts"))),
        F.when(paused, F.lit("delete-propagation paused (inbound sync OK)")),
    )
    last = F.coalesce(F.when(idle.isNotNull(), staleness(idle)), F.lit("never"))
    return (
        F.when(redflag, F.lit("🛑 redflag.md present — sync HALTED")).when(verifying, F.lit("⟳ Verifying vault… scanning files"))
        .when(broken, F.concat(F.lit("❌ Disconnected • "), F.coalesce(error, F.lit("unknown")))).when(parts != "", F.concat(F.lit("⚠ "), parts))
        .when(pending > 0, F.concat(F.lit("Syncing ⟳ • "), text(pending), F.lit(" pending • last error: "), F.coalesce(error, F.lit("none"))))
        .otherwise(F.concat(F.lit("Synced ✓ • "), text(received), F.lit(" ↓ "), text(sent), F.lit(" ↑ last "), last))
    )
