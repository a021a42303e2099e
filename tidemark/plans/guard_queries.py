"""Journal, ordered guards and watchdogs (WIN, ORD, SNK-1/2, JOIN-6..9 and related rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import ordered as O
from tidemark.operators import reconcile as R
from tidemark.operators import stores as St
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import with_sql
from tidemark.sources.tables import table


@query("win1_compact", with_sql("SELECT path, action, content_sha, line_no FROM journal QUALIFY row_number() OVER (PARTITION BY path ORDER BY line_no DESC) = 1", "journal"))
def win1(spark, sf):
    return O.compact(X.journal(spark, sf)).select("path", "action", "content_sha", "line_no")


@query("win5_append_prefix", with_sql("SELECT line_no, line_bytes, sum(line_bytes) OVER (ORDER BY line_no)::BIGINT AS run_bytes, sum(line_bytes) OVER (ORDER BY line_no) + 1000 <= 500000 AS fits FROM journal", "journal"))
def win5_snk1(spark, sf):
    """SNK-1: rows that no longer fit are dropped; rows are positive, so those that fit are a prefix."""
    return O.append_within(X.journal(spark, sf), 1000, 500_000).select("line_no", "line_bytes", "run_bytes", "fits")


@query("snk2_single_append", with_sql("SELECT line_no, CASE WHEN line_bytes + 99980000 > 100000000 THEN 'error_over_cap' ELSE 'ok' END AS status FROM (SELECT line_no, line_bytes * 100 AS line_bytes FROM journal)", "journal"))
def snk2(spark, sf):
    """A single append over the cap is an error, unlike in a batch."""
    return X.journal(spark, sf).select("line_no", S.single_append(F.col("line_bytes") * 100, 99_980_000, 100_000_000).alias("status"))


_BURST = """e AS (SELECT *, coalesce(sum(is_reset::INT) OVER (PARTITION BY root ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM burst_events),
 t AS (SELECT event_id, ts, root, epoch, coalesce(lag(ts, 2) OVER (PARTITION BY root, epoch ORDER BY ts, event_id) > ts - INTERVAL 6 HOUR, false) AS hit FROM e WHERE NOT is_reset),
 v AS (SELECT e.event_id, e.root, is_reset, coalesce(max(hit::INT) OVER (PARTITION BY e.root, e.epoch ORDER BY e.ts, e.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS paused, coalesce(hit, false) AS hit FROM e LEFT JOIN t ON t.event_id = e.event_id)"""


@query("win2_delete_burst", with_sql("WITH " + _BURST + " SELECT event_id, root, is_reset, paused, hit AND NOT paused AS tripped FROM v", "burst_events"))
def win2_fn7(spark, sf):
    """FN-7: whether a reset found the valve shut. The delete that trips is itself let through; those after it are not."""
    return O.delete_burst(X.burst_events(spark, sf), 3, "6 HOURS").select("event_id", "root", "is_reset", "paused", "tripped")


@query("win2_window_zero", with_sql("SELECT event_id, root, is_reset, false AS paused, false AS tripped FROM burst_events", "burst_events"))
def win2_zero(spark, sf):
    return O.delete_burst(X.burst_events(spark, sf), 1, "0 SECONDS").select("event_id", "root", "is_reset", "paused", "tripped")


@query("win3_join6_echo", with_sql("""WITH r AS (SELECT *, max(CASE WHEN kind = 'record' THEN rn END) OVER (PARTITION BY key ORDER BY rn) AS rr FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM echo_events)),
 p AS (SELECT p.event_id, p.key, p.ts, p.rr, coalesce(q.sha = p.sha AND p.ts < q.ts + INTERVAL 6 HOUR, false) AS hit FROM r p LEFT JOIN r q ON p.key = q.key AND p.rr = q.rn WHERE p.kind = 'probe')
 SELECT event_id, key, hit AND row_number() OVER (PARTITION BY key, rr, hit ORDER BY ts, event_id) = 1 AS suppressed FROM p""", "echo_events"))
def win3(spark, sf):
    return O.echo(X.echo_events(spark, sf), "6 HOURS")


@query("win4_join13_enqueue", with_sql("""WITH j AS (SELECT line_no, path, action, sha256((line_no % 3)::VARCHAR) AS sha, line_no % 7 <> 0 AS ok, CASE WHEN line_no % 2 = 0 THEN sha256('1') END AS shadow FROM journal),
 e AS (SELECT *, sum((action = 'delete')::INT) OVER (PARTITION BY path ORDER BY line_no) AS epoch FROM j),
 l AS (SELECT *, last_value(CASE WHEN ok THEN sha END IGNORE NULLS) OVER (PARTITION BY path, epoch ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e WHERE action <> 'delete')
 SELECT line_no, path, seen AS last_enqueued, coalesce(seen = sha AND shadow = sha, false) AS dup FROM l""", "journal"))
def win4(spark, sf):
    j = X.journal(spark, sf).select("line_no", "path", "action", F.sha2((F.col("line_no") % 3).cast("string"), 256).alias("content_sha"), (F.col("line_no") % 7 != 0).alias("append_ok"))
    j = j.withColumn("shadow_hash", F.when(F.col("line_no") % 2 == 0, F.sha2(F.lit("1"), 256)))
    return O.enqueue(j).select("line_no", "path", "last_enqueued", "dup")


@query("win6_heartbeat", """WITH b AS (SELECT event_id, ts, user_id % 10 AS device, CASE event_type WHEN 'signup' THEN 200 WHEN 'error' THEN 500 ELSE 405 END AS status FROM events),
 e AS (SELECT *, sum((status = 200)::INT) OVER (PARTITION BY device ORDER BY ts, event_id) AS epoch FROM b),
 n AS (SELECT event_id, device, row_number() OVER (PARTITION BY device, epoch ORDER BY ts, event_id) AS n FROM e WHERE status = 405)
 SELECT event_id, device, n, CASE WHEN n = 1 THEN 'once' WHEN n <= 12 THEN 'quiet' ELSE 'escalate' END AS action FROM n""")
def win6(spark, sf):
    status = F.when(F.col("event_type") == "signup", 200).when(F.col("event_type") == "error", 500).otherwise(405)
    beats = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 10).alias("device"), status.alias("status"))
    return O.heartbeat_streaks(beats).select("event_id", "device", "n", "action")


def _attempts(spark, sf):
    return X.journal(spark, sf).select("path", "line_no", (F.col("action") == "create").alias("is_clear"), F.col("queued_at").alias("ts"), F.repeat(F.col("content_sha"), F.when(F.col("line_no") % 2 == 0, 20).otherwise(1)).alias("error"))


_LEDGER = """WITH e AS (SELECT *, sum((action = 'create')::INT) OVER (PARTITION BY path ORDER BY line_no) AS epoch FROM journal),
 f AS (SELECT *, max(epoch) OVER (PARTITION BY path) AS last_epoch FROM e),
 g AS (SELECT path, count(*)::BIGINT AS attempts, min(queued_at) AS first_failed, max(queued_at) AS last_attempt, arg_max(CASE WHEN line_no % 2 = 0 THEN left(repeat(content_sha, 20), 512) || '...' ELSE content_sha END, line_no) AS last_error FROM f WHERE epoch = last_epoch AND action <> 'create' GROUP BY path)"""


@query("win7_agg6_ledger", with_sql(_LEDGER + " SELECT path, attempts, first_failed, last_attempt, last_error FROM g", "journal"))
def win7_agg6_kv4(spark, sf):
    return O.retry_ledger(_attempts(spark, sf))


@query("win8_snk7_free_names", """WITH w AS (SELECT source AS base, doc_id AS ord, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents WHERE doc_id % 5 = 0),
 t AS (SELECT DISTINCT source AS base, (doc_id % 9 + 1)::INT AS slot FROM documents WHERE doc_id % 7 = 0),
 s AS (SELECT b.base, r.slot, row_number() OVER (PARTITION BY b.base ORDER BY r.slot) AS k FROM (SELECT DISTINCT base FROM w) b, range(1, 5000) AS r(slot) WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.base = b.base AND t.slot = r.slot))
 SELECT w.base, w.ord, s.slot::INT AS slot, CASE WHEN s.slot = 1 THEN w.base ELSE w.base || '-' || s.slot END AS name FROM w JOIN s ON w.base = s.base AND w.k = s.k""")
def win8_snk7(spark, sf):
    d = table(spark, sf, "documents")
    wanted = d.filter("doc_id % 5 = 0").select(F.col("source").alias("base"), F.col("doc_id").alias("ord"))
    taken = d.filter("doc_id % 7 = 0").select(F.col("source").alias("base"), (F.col("doc_id") % 9 + 1).cast("int").alias("slot")).distinct()
    return O.free_suffix(wanted, taken)


#: Row by row of each root, with the admitted times that still count.
BREAKER_SQL = """WITH RECURSIVE e AS (SELECT event_id, user_id % 8 AS root, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 8 ORDER BY ts, event_id) AS n FROM events),
 a AS (SELECT root, n, event_id, true AS admitted, [t] AS held FROM e WHERE n = 1
  UNION ALL SELECT root, n, event_id, len(h) < 5, CASE WHEN len(h) < 5 THEN list_append(h, t) ELSE h END
   FROM (SELECT e.root, e.n, e.event_id, e.t, list_filter(a.held, lambda x: e.t - x <= 21600000000) AS h FROM a JOIN e ON e.root = a.root AND e.n = a.n + 1))
 SELECT root, event_id, admitted FROM a"""


@query("win9_conflict_breaker", BREAKER_SQL)
def win9(spark, sf):
    """Admission hangs on earlier admissions."""
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("root"))
    return O.admission(e, 5, 6 * 3600)


@query("win10_capacity_fence", """WITH a AS (SELECT event_id, ts, user_id % 8 AS root, event_type <> 'signup' AS is_cap FROM events),
 i AS (SELECT *, sum((NOT is_cap)::INT) OVER w AS island FROM a WINDOW w AS (PARTITION BY root ORDER BY ts, event_id)),
 h AS (SELECT *, is_cap AND sum(is_cap::INT) OVER (PARTITION BY root, island ORDER BY ts, event_id) = 12 AS hit FROM i)
 SELECT event_id, root, is_cap, hit AND coalesce(max(hit::INT) OVER (PARTITION BY root ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS tripped,
 max(hit::INT) OVER (PARTITION BY root ORDER BY ts, event_id) = 1 AS fenced FROM h""")
def win10(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("root"), (F.col("event_type") != "signup").alias("is_cap"))
    return O.capacity_streak(e, 12).select("event_id", "root", "is_cap", "tripped", "fenced")


_IDLE = """WITH a AS (SELECT event_id, ts, user_id % 8 AS root, event_type = 'purchase' OR event_id % 20 = 0 AS p FROM events),
 l AS (SELECT *, last_value(CASE WHEN p THEN ts END IGNORE NULLS) OVER (PARTITION BY root ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lp FROM a),
 i AS (SELECT event_id, root, floor((epoch_us(ts) - epoch_us(lp)) / 1000000)::BIGINT AS idle FROM l)"""


def _idle(spark, sf):
    p = (F.col("event_type") == "purchase") | (F.col("event_id") % 20 == 0)
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("root"), p.alias("is_progress"))
    return O.idle_seconds(e).withColumn("idle", F.col("idle").cast("long"))


@query("win11_idle", _IDLE + " SELECT event_id, root, idle FROM i")
def win11(spark, sf):
    return _idle(spark, sf).select("event_id", "root", "idle")


@query("dec14_recovery", _IDLE + """ SELECT event_id, CASE WHEN event_id % 3 > 0 AND coalesce(idle, 0) >= 900 THEN 'push_stall' WHEN event_id % 11 = 0 THEN 'watcher_fenced' WHEN coalesce(idle, 0) >= 300 THEN 'watcher_stale' ELSE 'none' END AS action FROM i""")
def dec14(spark, sf):
    """The first of stall, fence and stale watcher; an idle time without a stamp counts as 0."""
    out = S.recovery_trigger(F.col("event_id") % 3, F.col("idle"), F.col("event_id") % 11 == 0, F.col("idle"))
    return _idle(spark, sf).select("event_id", F.coalesce(out, F.lit("none")).alias("action"))


@query("dec14_recovery_by_stamps", """WITH a AS (SELECT event_id, ts, user_id % 8 AS root, event_type AS k FROM events),
 c AS (SELECT *, (count(*) FILTER (k = 'click') OVER w - count(*) FILTER (k = 'purchase') OVER w)::BIGINT AS pending, max(ts) FILTER (k = 'purchase') OVER w AS went, max(ts) FILTER (k = 'view') OVER w AS sign, min(ts) OVER w AS start,
  count(*) FILTER (k IS DISTINCT FROM 'signup') OVER w AS island FROM a WINDOW w AS (PARTITION BY root ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 s AS (SELECT *, k = 'signup' AND count(*) FILTER (k = 'signup') OVER (PARTITION BY root, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 3 AS hit FROM c),
 f AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY root ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS fenced, floor((epoch_us(ts) - epoch_us(coalesce(went, start))) / 1000000)::BIGINT AS idle, floor((epoch_us(ts) - epoch_us(sign)) / 1000000)::BIGINT AS silent FROM s)
 SELECT event_id, root, pending, idle, silent, fenced, CASE WHEN pending > 0 AND idle >= 900 THEN 'push_stall' WHEN fenced THEN 'watcher_fenced' WHEN silent >= 300 THEN 'watcher_stale' END AS trigger FROM f""")
def dec14_stamps(spark, sf):
    """Clicks wait, purchases are sent, views are the watcher's signs and signups refused appends."""
    kinds = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "purchase", "sent").when(F.col("event_type") == "view", "alive").when(F.col("event_type") == "signup", "full")
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("root"), kinds.alias("kind"))
    return O.recovery(e, 3).drop("ts", "kind")


@query("win12_debounce", """WITH g AS (SELECT event_id, ts, user_id AS key, coalesce(ts - lag(ts) OVER w >= INTERVAL 30 MINUTE, true) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new::INT) OVER (PARTITION BY key ORDER BY ts) AS k FROM g) SELECT key, min(ts) AS start, count(*)::BIGINT AS n, max(event_id) AS last_id FROM s GROUP BY key, k""")
def win12(spark, sf):
    """An approximation: how the original lumps bursts is not published."""
    e = table(spark, sf, "events").select("event_id", "ts", F.col("user_id").alias("key"))
    return O.bursts(e, "30 minutes")


@query("win13_backoff", "SELECT doc_id, least(500 * (1::BIGINT << least(doc_id % 70, 40)::INT), 60000)::BIGINT AS ms FROM documents")
def win13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", O.backoff(F.col("doc_id") % 70, 500, 60_000).alias("ms"))


@query("join7_ack", with_sql("SELECT event_id, path FROM journal WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)", "journal"))
def join7_kv6_set2(spark, sf):
    """Ids that are not in the journal change nothing, nor does a refusal."""
    acked = table(spark, sf, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("event_id"))
    return St.ack(St.nack(X.journal(spark, sf), acked), acked, "event_id").select("event_id", "path")


@query("join8_join9_base", with_sql("""WITH s AS (SELECT 'notes/' || (r_regionkey * 7) || '.md' AS path, sha256(r_name) AS shadow FROM region)
 SELECT event_id, CASE WHEN base_hash IS NULL THEN shadow ELSE base_hash END AS base, CASE WHEN base_hash IS NULL THEN 'unknown' WHEN base_hash = '' THEN 'no_row' ELSE 'known' END AS kind FROM journal j LEFT JOIN s ON j.path = s.path""", "journal"))
def join8_scl21(spark, sf):
    """Three states: unknown (null) takes the baseline, no row ('') and known hashes stay as they are."""
    s = table(spark, sf, "region").select(F.concat(F.lit("notes/"), (F.col("r_regionkey") * 7).cast("string"), F.lit(".md")).alias("path"), F.sha2("r_name", 256).alias("shadow"))
    rows = R.declared_bases(X.journal(spark, sf), s.withColumnRenamed("shadow", "server_hash"), X.base_seq(spark, sf))
    return rows.select("event_id", "base", F.col("base_kind").alias("kind"))


@query("ord2_drain", with_sql("SELECT line_no, path FROM journal ORDER BY line_no LIMIT 32", "journal"))
def ord2(spark, sf):
    return X.journal(spark, sf).orderBy("line_no").limit(32).select("line_no", "path")


@query("agg10_chains", with_sql("SELECT batch, path, count(*)::BIGINT AS n, string_agg(action, '>' ORDER BY line_no) AS chain FROM (SELECT *, (row_number() OVER (ORDER BY line_no) - 1) // 32 AS batch FROM journal) GROUP BY batch, path", "journal"))
def agg10(spark, sf):
    """The whole journal, drained in batches of 32 lines: each batch by path, order kept; the lists hold 32 actions at most."""
    return O.chains(X.journal(spark, sf), 32)


@query("agg11_depth", with_sql("SELECT count(*)::BIGINT AS depth, sum(line_bytes)::BIGINT AS bytes, count(*) = 0 AS is_empty FROM journal", "journal"))
def agg11(spark, sf):
    return X.journal(spark, sf).agg(F.count(F.lit(1)).alias("depth"), F.sum("line_bytes").alias("bytes"), (F.count(F.lit(1)) == 0).alias("is_empty"))


_CODES, _ANSWERS = (200, 201, 409, 401, 403, 426, 400, 422, 503, 404, 500, None), ("accepted", "merged", "conflict_markers", "error", "odd", None)
_STATUS = "[" + ", ".join("NULL" if c is None else str(c) for c in _CODES) + "][doc_id % 12 + 1]"
_BODY = "[" + ", ".join("NULL" if c is None else f"'{c}'" for c in _ANSWERS) + "][(doc_id // 12) % 6 + 1]"
_OUTCOME = f"""CASE WHEN {_STATUS} IN (200, 201) THEN CASE {_BODY} WHEN 'accepted' THEN 'sent' WHEN 'merged' THEN 'merged' WHEN 'conflict_markers' THEN 'conflict_markers' ELSE 'network_exhausted' END
 WHEN {_STATUS} = 409 THEN 'conflict_unrecoverable' WHEN {_STATUS} = 401 THEN 'unauthorized' WHEN {_STATUS} = 403 THEN 'forbidden' WHEN {_STATUS} = 426 THEN 'upgrade_required' WHEN {_STATUS} IN (400, 422) THEN 'skipped' ELSE 'network_exhausted' END"""


def _responses(spark, sf):
    """Responses of every known and unknown status with every answer, nulls included."""
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), n.cast("int"))
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", "lang", pick(_CODES, d % 12 + 1).alias("status"), pick(_ANSWERS, F.floor(d / 12) % 6 + 1).alias("body"))
    return rows.withColumn("outcome", S.response_outcome(F.col("status"), F.col("body")))


@query("scl25_dec11_outcomes", f"SELECT doc_id, {_OUTCOME} AS outcome, {_OUTCOME} NOT IN ('network_exhausted', 'upgrade_required') AS acked FROM documents")
def scl25_dec11_snk10(spark, sf):
    """A response's outcome and whether its journal line is acknowledged."""
    return _responses(spark, sf).select("doc_id", "outcome", S.is_acked(F.col("outcome")).alias("acked"))


@query("agg12_progress", f"""WITH o AS (SELECT lang, bool_or(o IN ('sent', 'merged')) AS synced, count(*) AS n, count(*) FILTER (WHERE o = 'skipped')::BIGINT AS skipped FROM (SELECT lang, {_OUTCOME} AS o FROM documents WHERE doc_id % 5 < 3) GROUP BY lang),
 p AS (SELECT lang, count(*) FILTER (WHERE doc_id % 5 = 3) AS pending FROM documents GROUP BY lang UNION ALL SELECT 'idle', 0 UNION ALL SELECT 'stuck', 3)
 SELECT p.lang, coalesce(synced, false) AS synced, coalesce(n, 0) > 0 OR pending = 0 AS progress, coalesce(skipped, 0) AS skipped FROM p LEFT JOIN o ON p.lang = o.lang""")
def agg12(spark, sf):
    """By language as a drain; one is idle with nothing to do, one is stuck."""
    pending = table(spark, sf, "documents").groupBy("lang").agg(F.count_if(F.col("doc_id") % 5 == 3).alias("pending"))
    pending = pending.unionByName(spark.createDataFrame([("idle", 0), ("stuck", 3)], "lang string, pending long"))
    return R.drain_progress(_responses(spark, sf).filter("doc_id % 5 < 3"), pending, "lang")


@query("scl24_ack_hash", f"SELECT doc_id, CASE WHEN {_BODY} IN ('accepted', 'merged') THEN coalesce(CASE WHEN doc_id % 3 = 0 THEN sha256(text) END, CASE WHEN doc_id % 5 = 0 THEN sha256(lang) END, sha256(source)) END AS hash FROM documents")
def scl24(spark, sf):
    d = F.col("doc_id")
    rows = _responses(spark, sf).select("doc_id", "body").join(table(spark, sf, "documents"), "doc_id")
    return rows.select("doc_id", S.ack_hash(F.col("body"), F.when(d % 3 == 0, F.sha2("text", 256)), F.when(d % 5 == 0, F.sha2("lang", 256)), F.sha2("source", 256)).alias("hash"))


@query("dec19_cooldown", """WITH a AS (SELECT event_id, ts, user_id % 8 AS root, event_id % 40 = 0 AS arm FROM events),
 l AS (SELECT *, last_value(CASE WHEN arm THEN ts END IGNORE NULLS) OVER (PARTITION BY root ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS armed FROM a)
 SELECT event_id, coalesce(ts < armed + INTERVAL 900 SECOND, false) AS held FROM l""")
def dec19(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", (F.col("user_id") % 8).alias("root"), (F.col("event_id") % 40 == 0).alias("arm"))
    return O.cooldown(e, 900).select("event_id", "held")


@query("fn5_fn8_last_state", "SELECT user_id, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id FROM events GROUP BY user_id")
def fn8(spark, sf):
    """Setters: the last write wins."""
    return O.last_state(table(spark, sf, "events"), "user_id", "event_type", "event_id").select("user_id", F.col("event_type").alias("last_type"), F.col("event_id").alias("last_id"))


@query("dec15_restart", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN false WHEN n_chars * 60 >= 86400 THEN true WHEN doc_id % 4 = 0 OR doc_id % 5 = 0 OR doc_id % 11 = 0 THEN false WHEN doc_id % 7 = 0 THEN true ELSE length(text) % 700 >= 300 END AS restart FROM documents""")
def dec15(spark, sf):
    """The length of a text as the time since an update was staged; every seventh never saw any activity."""
    d = F.col("doc_id")
    idle = F.when(d % 7 != 0, F.length("text") % 700)
    out = S.restart_now(d % 3 != 0, F.col("n_chars") * 60, idle, F.when(d % 4 == 0, d + 1).otherwise(0), d % 5 == 0, d % 11 == 0, 300, 86_400)
    return table(spark, sf, "documents").select("doc_id", out.alias("restart"))
