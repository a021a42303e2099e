"""Reconcile, pull, push and backfill passes over the derived replicas (JOIN, DEC, AGG, SNK and SET rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import content as C
from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.operators import ordered as O
from tidemark.operators import reconcile as R
from tidemark.operators import stores as St
from tidemark.plans import content_queries as CQ
from tidemark.plans.registry import query
from tidemark.plans.staging import shared_dir, stage
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import with_sql
from tidemark.sources.tables import table

_STATES = """WITH st AS (SELECT l.path, l.content_hash, l.size_bytes, s.fs_hash AS server_hash, s.change_seq,
  CASE WHEN s.fs_hash IS NULL THEN 'missing-on-server' WHEN s.fs_hash = l.content_hash THEN 'match' ELSE 'drift' END AS state
  FROM local_manifest l LEFT JOIN server_state s ON l.path = s.path)"""
_SHADOWED = _STATES + """, sh AS (SELECT st.*, w.server_hash AS shadow_hash FROM st LEFT JOIN shadow w ON st.path = w.path)"""
_DIRECTION = "CASE WHEN state = 'drift' THEN CASE WHEN shadow_hash = server_hash THEN 'push' ELSE 'pull' END WHEN state = 'missing-on-server' THEN 'push' ELSE 'noop' END"
_DECIDE = """CASE WHEN coalesce(content_hash = server_hash, false) THEN 'R1_noop' WHEN shadow_hash IS NULL THEN 'R5_conflict'
  WHEN coalesce(shadow_hash = server_hash, false) THEN 'R2_preserve_local' WHEN coalesce(content_hash = shadow_hash, false) THEN 'R3_pull_clean' ELSE 'R4_conflict' END"""
_ALL = ("local_manifest", "server_state", "shadow")


def _states(spark, sf):
    return R.states(X.local_manifest(spark, sf), X.server_state(spark, sf))


def _shadowed(spark, sf):
    return R.with_shadow(_states(spark, sf), X.shadow(spark, sf))


def _directed(spark, sf):
    rows = _shadowed(spark, sf)
    return rows.withColumn("direction", R.direction(F.col("state"), F.col("server_hash"), F.col("shadow_hash")))


def _decided(spark, sf):
    rows = _shadowed(spark, sf).filter("server_hash IS NOT NULL")
    return rows.withColumn("decision", R.decide_rows(rows))


_DECIDED = _SHADOWED + f", de AS (SELECT *, {_DECIDE} AS decision FROM sh WHERE server_hash IS NOT NULL)"


@query("src2_local_manifest", with_sql("SELECT path, content_hash, size_bytes FROM local_manifest", "local_manifest"))
def src2(spark, sf):
    return X.local_manifest(spark, sf).drop("doc_id")


@query("join1_states", with_sql(_STATES + " SELECT * FROM st", "local_manifest", "server_state"))
def join1(spark, sf):
    return _states(spark, sf)


@query("reconcile_direction", with_sql(_SHADOWED + f" SELECT path, state, {_DIRECTION} AS direction FROM sh", *_ALL))
def join2_dec2(spark, sf):
    return _directed(spark, sf).select("path", "state", "direction")


@query("join3_push_entries", with_sql(_SHADOWED + f" SELECT path, size_bytes, content_hash, CASE WHEN state = 'drift' THEN server_hash ELSE '' END AS base_hash FROM sh WHERE {_DIRECTION} = 'push'", *_ALL))
def join3_proj2(spark, sf):
    """PROJ-2: rows to push with the base that they declare: the server's hash, or none ('')."""
    return R.push_entries(_directed(spark, sf).filter("direction = 'push'"), X.local_manifest(spark, sf)).drop("error")


@query("join4_backfill", with_sql("SELECT s.path, s.change_seq FROM server_state s WHERE NOT EXISTS (SELECT 1 FROM local_manifest l WHERE l.path = s.path)", "local_manifest", "server_state"))
def join4(spark, sf):
    return R.backfill(X.server_state(spark, sf), X.local_manifest(spark, sf)).select("path", "change_seq")


@query("agg4_backfill_stats", with_sql("""SELECT count(*)::BIGINT AS enumerated, count(*) FILTER (WHERE l.path IS NULL)::BIGINT AS to_pull,
  (count(*) - count(*) FILTER (WHERE l.path IS NULL))::BIGINT AS already_present FROM server_state s LEFT JOIN local_manifest l ON s.path = l.path""", "local_manifest", "server_state"))
def agg4(spark, sf):
    s, l = X.server_state(spark, sf), X.local_manifest(spark, sf).select("path", F.lit(True).alias("here"))
    pull = F.col("here").isNull() & P.is_safe(F.col("path"))
    n = F.count(F.lit(1))
    return s.join(l, "path", "left").agg(n.alias("enumerated"), F.count_if(pull).alias("to_pull"), (n - F.count_if(pull)).alias("already_present"))


@query("dec1_decide", with_sql(_DECIDED + " SELECT path, decision FROM de", *_ALL))
def dec1(spark, sf):
    return _decided(spark, sf).select("path", "decision")


@query("dec1_counts", with_sql(_DECIDED + " SELECT decision, count(*)::BIGINT AS n FROM de GROUP BY decision", *_ALL))
def dec1_counts(spark, sf):
    return _decided(spark, sf).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


#: Notes of both sides as X.sides() has them, what they compare as, and the decision on each.
_CONTENT = f"""notes0 AS ({X.SQL["notes"]}), n0 AS (SELECT doc_id, note, {CQ._PULL} AS f FROM notes0), n1 AS (SELECT *, substr(f, length({CQ._BLOCK.format('f')}) + 1) AS body FROM n0),
 sd AS (SELECT n1.doc_id, source || '/' || lang || '/' || n1.doc_id || '.md' AS path, n1.doc_id % 3 AS root, n1.doc_id * 600 AS secs, note AS local,
  CASE n1.doc_id % 7 WHEN 1 THEN body WHEN 2 THEN note || chr(10) || 'server-edit' WHEN 3 THEN {CQ._FOLD.format('note')} WHEN 4 THEN body || chr(10) || 'server-edit' WHEN 5 THEN concat('---', chr(10), 'k: v', chr(10), '---', chr(10), body) ELSE note END AS server,
  CASE WHEN n1.doc_id % 11 = 0 THEN note || chr(10) || 'later' ELSE note END AS now FROM n1 JOIN documents d ON d.doc_id = n1.doc_id),
 notes AS (SELECT 2 * doc_id AS doc_id, local AS note FROM sd UNION ALL SELECT 2 * doc_id + 1, server FROM sd), {CQ._fm_sql(CQ._PULL)},
 pt AS (SELECT doc_id, {CQ._BOM1} AS n, {CQ._PULL} AS f FROM notes), pr AS (SELECT doc_id, starts_with(n, '---' || chr(10)) OR starts_with(n, '---' || chr(13) || chr(10)) OR n = '---' AS block, substr(f, length({CQ._BLOCK.format('f')}) + 1) AS body FROM pt),
 hs AS (SELECT sd.*, sha256(a.form) AS content_hash, sha256(b.form) AS server_hash, x.block AND NOT y.block AS strips, x.body = y.body AS same_body FROM sd JOIN frm a ON a.doc_id = 2 * sd.doc_id JOIN frm b ON b.doc_id = 2 * sd.doc_id + 1
  JOIN pr x ON x.doc_id = 2 * sd.doc_id JOIN pr y ON y.doc_id = 2 * sd.doc_id + 1),
 sh AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN server_hash WHEN 1 THEN content_hash WHEN 2 THEN sha256(path) END AS shadow_hash FROM hs), de AS (SELECT *, {_DECIDE} AS decision FROM sh)"""
_GUARD = "CASE WHEN strips AND (decision LIKE '%pull_clean%' OR decision LIKE '%conflict%') THEN CASE WHEN same_body THEN 'preserve_and_push' ELSE 'stash_then_align' END ELSE 'none' END"
_ALIGN = "CASE WHEN decision LIKE '%noop%' AND local <> server THEN 'align' ELSE 'keep' END"
_REWRITE = "CASE WHEN now IS NULL THEN 'skip_missing' WHEN now <> local THEN 'skip_concurrent_edit' WHEN strips THEN 'skip_frontmatter_strip' ELSE 'written' END"
#: Admission to the breaker of the rows `asked` (root, secs, doc_id), each after the one before it.
_ADMIT = """nb AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY secs, doc_id) AS n FROM asked),
 ad AS (SELECT root, n, doc_id, true AS admitted, [secs] AS held FROM nb WHERE n = 1
  UNION ALL SELECT root, n, doc_id, len(h) < 5, CASE WHEN len(h) < 5 THEN list_append(h, secs) ELSE h END FROM (SELECT nb.*, list_filter(ad.held, lambda x: nb.secs - x <= 21600) AS h FROM ad JOIN nb ON nb.root = ad.root AND nb.n = ad.n + 1))"""


def _contents(spark, sf):
    """Whole notes of both sides with what they compare as, each test by its own function."""
    form = lambda c: C.sha(C.pull_form(F.col(c), X.STRIP))
    rows = X.sides(spark, sf).withColumn("content_hash", form("local")).withColumn("server_hash", form("server"))
    based = F.when(F.col("base") == "server", F.col("server_hash")).when(F.col("base") == "local", F.col("content_hash")).when(F.col("base") == "other", F.sha2(F.col("path"), 256))
    rows = rows.withColumn("shadow_hash", based)
    return rows.withColumn("decision", R.decide_rows(rows)).withColumn("strips", C.has_frontmatter(F.col("local")) & ~C.has_frontmatter(F.col("server")))


@query("dec3_dec4_guard", f"WITH {_CONTENT} SELECT doc_id, decision, {_GUARD} AS guard_arm, {_ALIGN} AS alignment FROM de")
def dec3_dec4(spark, sf):
    """What a pull that would drop frontmatter becomes, by the two bodies; what a no-op whose bytes differ becomes."""
    d = F.col("decision")
    same_body = C.body_only(F.col("local")) == C.body_only(F.col("server"))
    return _contents(spark, sf).select("doc_id", "decision", R.guard(d, F.col("strips"), same_body).alias("guard_arm"), R.align(d, F.col("local") == F.col("server")).alias("alignment"))


@query("dec5_dec6_conflicts", with_sql(f"""WITH RECURSIVE {_CONTENT}, ca AS (SELECT de.doc_id, de.root, de.secs, shadow_hash IS NOT NULL AS known, CASE WHEN decision LIKE '%conflict%' AND coalesce(prov = 'adopted' AND change_seq <= seq, false) THEN 'preserve_local' ELSE decision END AS final
  FROM de LEFT JOIN server_state s ON s.path = de.path LEFT JOIN base_seq b ON b.path = de.path),
 asked AS (SELECT root, secs, doc_id FROM ca WHERE final LIKE '%conflict%' AND (known OR root = 0)), {_ADMIT}
 SELECT ca.doc_id, final, CASE WHEN final NOT LIKE '%conflict%' THEN 'not_conflict' WHEN NOT known AND ca.root <> 0 THEN 'skip_scope_suspect' WHEN NOT coalesce(admitted, true) THEN 'skip_breaker' ELSE 'stash_and_write' END AS outcome
 FROM ca LEFT JOIN ad ON ad.doc_id = ca.doc_id""", "server_state", "base_seq"))
def dec5_dec6_snk4(spark, sf):
    """SNK-4: the outcome of a write for every conflicting pull. The store of root 0 has keys without folders, so only the
    others are suspect; what the store does not hold back goes to the breaker in order of time."""
    rows = _contents(spark, sf).select("doc_id", "path", "root", "ts", "decision", F.col("shadow_hash").isNotNull().alias("known"))
    seq = X.server_state(spark, sf).select("path", "change_seq").join(X.base_seq(spark, sf), "path", "full")
    rows = rows.join(seq, "path", "left").withColumn("final", R.causal(F.col("decision"), F.col("change_seq"), F.col("seq"), F.col("prov")))
    rows = stage(rows.select("doc_id", "path", "root", "ts", "known", "final"), "conflicts")
    keys = rows.filter("known").select("root", F.when(F.col("root") == 0, P.basename(F.col("path"))).otherwise(F.col("path")).alias("key"))
    suspect = St.scope_suspect(keys, (), ("root",)).select("root", F.col("suspect").isNotNull().alias("suspect"))
    rows = rows.join(suspect, "root", "left").withColumn("suspect", F.coalesce("suspect", F.lit(False)))
    asked = rows.filter(F.col("final").contains("conflict") & (F.col("known") | ~F.col("suspect"))).select("root", "ts", F.col("doc_id").alias("event_id"))
    admitted = O.admission(asked, 5, 6 * 3600).select(F.col("event_id").alias("doc_id"), "admitted")
    out = R.mint(F.col("final"), F.col("known"), F.col("suspect"), ~F.coalesce("admitted", F.lit(True)))
    return rows.join(admitted, "doc_id", "left").select("doc_id", "final", out.alias("outcome"))


_OUTCOMES = ("error", "integrity_failed", "breaker_open", "local_edit_preserved", "guard_preserve_push_up", "shadow_scope_suspect", "written", "identical")
_OUT_SQL = "[" + ", ".join(f"'{x}'" for x in _OUTCOMES) + "][doc_id % 8 + 1]"
_CLASS_SQL = f"CASE WHEN {_OUT_SQL} IN ('error', 'integrity_failed') THEN 'failed' WHEN {_OUT_SQL} IN ('breaker_open', 'local_edit_preserved', 'guard_preserve_push_up', 'shadow_scope_suspect') THEN 'deferred' ELSE 'succeeded' END"


@query("dec7_pull_classes", f"SELECT lang, {_CLASS_SQL} AS class, count(*)::BIGINT AS n FROM documents GROUP BY 1, 2")
def dec7(spark, sf):
    d = table(spark, sf, "documents")
    outcome = F.element_at(F.array(*[F.lit(x) for x in _OUTCOMES]), (F.col("doc_id") % 8 + 1).cast("int"))
    return d.groupBy("lang", R.pull_class(outcome).alias("class")).agg(F.count(F.lit(1)).alias("n"))


#: What becomes of a pull: most are written, some never run.
_PULLS = ("error", "integrity_failed", "breaker_open", "local_edit_preserved", "guard_preserve_push_up", "shadow_scope_suspect", "", *["written"] * 57)
_OUTCOME = f"nullif({list(_PULLS)}[('0x' || left(server_hash, 2))::INT % 64 + 1], '')"
_FAILED, _DEFERRED = "('error', 'integrity_failed')", "('breaker_open', 'local_edit_preserved', 'guard_preserve_push_up', 'shadow_scope_suspect')"
_REPORT = f""", di AS (SELECT split_part(path, '/', 1) AS root, path, {_DIRECTION} AS d, CASE WHEN {_DIRECTION} = 'pull' THEN CASE WHEN {_OUTCOME} IN {_FAILED} THEN 'f' WHEN {_OUTCOME} IN {_DEFERRED} OR {_OUTCOME} IS NULL THEN 'd' ELSE 's' END END AS c FROM sh),
 rn AS (SELECT *, row_number() OVER (PARTITION BY root, d = 'push', c = 's', c IN ('f', 'd') ORDER BY path) AS rn FROM di),
 re AS (SELECT root, count(*) AS files_scanned, count(*) FILTER (WHERE d = 'push') AS modify_count, count(*) FILTER (WHERE c = 's') AS add_count, 0::BIGINT AS delete_count, count(c) AS pulls_attempted,
  count(*) FILTER (WHERE c = 's') AS pulls_succeeded, count(*) FILTER (WHERE c = 'f') AS pulls_failed, count(*) FILTER (WHERE c = 'd') AS pulls_deferred, count(*) FILTER (WHERE d <> 'push') AS files_in_sync,
  count(*) FILTER (WHERE c IN ('f', 'd')) AS still_divergent, count(*) FILTER (WHERE c IN ('f', 'd')) > 0 AS cycle_red, count(*) FILTER (WHERE c IN ('f', 'd')) = 0 AS soak_eligible,
  coalesce(list(path ORDER BY path) FILTER (WHERE d = 'push' AND rn <= 50), []) AS modify_sample, coalesce(list(path ORDER BY path) FILTER (WHERE c = 's' AND rn <= 50), []) AS add_sample,
  coalesce(list(path ORDER BY path) FILTER (WHERE c IN ('f', 'd') AND rn <= 50), []) AS unresolved_sample FROM rn GROUP BY root)"""


def _reports(spark, sf):
    """A pull's outcome goes by the head of its server hash."""
    outcome = F.nullif(F.element_at(F.array(*[F.lit(x) for x in _PULLS]), F.conv(F.left("server_hash", F.lit(2)), 16, 10).cast("int") % 64 + 1), F.lit(""))
    rows = _directed(spark, sf).withColumn("outcome", outcome).withColumn("root", F.split_part("path", F.lit("/"), F.lit(1)))
    return R.report(rows)


def _joined(rows, *names):
    """Lists as text, one path after another."""
    return rows.select(*[F.array_join(c, ",").alias(c) if c in names else c for c in rows.columns])


@query("agg1_agg2_report", with_sql(_SHADOWED + _REPORT + " SELECT * REPLACE (array_to_string(modify_sample, ',') AS modify_sample, array_to_string(add_sample, ',') AS add_sample, array_to_string(unresolved_sample, ',') AS unresolved_sample) FROM re", *_ALL))
def agg1_agg2_ord3(spark, sf):
    return _joined(_reports(spark, sf), "modify_sample", "add_sample", "unresolved_sample")


@query("agg3_agg7_rollup", with_sql(_SHADOWED + _REPORT + """ SELECT count(*) AS roots, sum(files_scanned)::BIGINT AS files_scanned, sum(files_in_sync)::BIGINT AS files_in_sync, sum(modify_count)::BIGINT AS modify_count, sum(add_count)::BIGINT AS add_count,
 0::BIGINT AS delete_count, array_to_string(flatten(list(modify_sample ORDER BY root)), ',') AS modify_sample, array_to_string(flatten(list(add_sample ORDER BY root)), ',') AS add_sample FROM re""", *_ALL))
def agg3_agg7_set1(spark, sf):
    return _joined(R.rollup(_reports(spark, sf)), "modify_sample", "add_sample")


@query("join15_seed_shadow", with_sql(_STATES + " SELECT path, server_hash FROM st WHERE state = 'match'", "local_manifest", "server_state"))
def join15_pred17(spark, sf):
    """The first pass, which finds no store; tests cover one that is there."""
    none = St.load(spark, f"{shared_dir(spark)}/no-store-yet", "path STRING, server_hash STRING")
    return R.seed_shadow(_states(spark, sf), none)


@query("join5_bodies", with_sql("""SELECT e.event_id, e.path, s.change_seq, s.fs_hash IS NOT NULL AS found FROM (SELECT event_id, 'src' || (user_id % 20) || '/en/' || (event_id % 1000) || '.md' AS path FROM events) e
  LEFT JOIN server_state s ON e.path = s.path""", "server_state"))
def join5_src7(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit("/en/"), (F.col("event_id") % 1000).cast("string"), F.lit(".md")).alias("path"))
    return R.bodies(e, X.server_state(spark, sf)).select("event_id", "path", "change_seq", "found")


@query("join14_deletes", with_sql("""SELECT l.path, CASE WHEN l.doc_id % 6 = 0 THEN 'noop_absent' WHEN w.server_hash IS NOT NULL AND l.size_bytes > 0 AND l.content_hash <> w.server_hash THEN 'stash_then_delete' ELSE 'delete' END AS outcome
  FROM local_manifest l LEFT JOIN shadow w ON l.path = w.path WHERE l.doc_id % 2 = 0""", *_ALL))
def join14_snk6(spark, sf):
    """Deletes of every second document, a third of which is gone already."""
    l = X.local_manifest(spark, sf)
    return R.deletes(l.filter("doc_id % 2 = 0").select("path"), X.shadow(spark, sf), l.filter("doc_id % 6 <> 0")).select("path", "outcome")


@query("snk5_compare_and_set", f"WITH {_CONTENT} SELECT doc_id, {_REWRITE} AS outcome FROM (SELECT * REPLACE (CASE WHEN doc_id % 13 <> 0 THEN now END AS now) FROM de)")
def snk5(spark, sf):
    """A file is rewritten only if it is still what was seen; every thirteenth is gone."""
    now = F.when(F.col("doc_id") % 13 != 0, C.sha(F.col("now")))
    rows = _contents(spark, sf).withColumn("content_hash", now)
    return R.compare_and_set(rows, C.sha(F.col("local")), F.col("strips")).select("doc_id", "outcome")


@query("dec8_stash_policy", """SELECT doc_id, p AS policy, CASE WHEN source = 'src1' OR p IN ('server_wins', 'manual') THEN true ELSE doc_id % 3 = 0 OR doc_id % 100 < 50 END AS stash
  FROM documents, (VALUES ('server_wins'), ('manual'), ('newer_wins')) AS v(p)""")
def dec8(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", F.explode(F.array(*[F.lit(p) for p in ("server_wins", "manual", "newer_wins")])).alias("policy"))
    path = F.when(F.col("source") == "src1", "x/credentials/a.md").otherwise("x/a.md")
    local = F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 100)
    return d.select("doc_id", "policy", R.stash_decision(path, F.col("policy"), local, F.lit(50)).alias("stash"))


@query("set2_set3_paths", with_sql("SELECT DISTINCT split_part(path, '/', 2) AS lang, path IN (SELECT path FROM shadow) AS known FROM server_state", *_ALL))
def set2_set3(spark, sf):
    s = X.server_state(spark, sf).join(X.shadow(spark, sf).select("path", F.lit(True).alias("k")), "path", "left")
    return s.select(F.split_part("path", F.lit("/"), F.lit(2)).alias("lang"), F.coalesce("k", F.lit(False)).alias("known")).dropDuplicates(["lang", "known"])


@query("src6_ord5_page", with_sql("SELECT path, change_seq, row_number() OVER (ORDER BY change_seq) AS rn FROM (SELECT * FROM server_state WHERE change_seq > 1000000100 ORDER BY change_seq LIMIT 50)", "server_state"))
def src6_ord5(spark, sf):
    """One page of the feed: a bounded top-k, then its numbering."""
    from pyspark.sql import Window

    page = X.server_state(spark, sf).filter("change_seq > 1000000100").orderBy("change_seq").limit(50)
    return page.select("path", "change_seq", F.row_number().over(Window.orderBy("change_seq")).cast("long").alias("rn"))


@query("kv1_kv2_upsert", with_sql("""WITH fresh AS (SELECT path, fs_hash FROM server_state WHERE doc_id % 6 = 0) SELECT path, server_hash FROM shadow WHERE path NOT IN (SELECT path FROM fresh) UNION ALL SELECT path, fs_hash FROM fresh""", *_ALL))
def kv1_kv2(spark, sf):
    """Store verbs: record is an upsert by key; get is a join, remove an anti join, len a count."""
    fresh = X.server_state(spark, sf).filter("doc_id % 6 = 0").select("path", F.col("fs_hash").alias("server_hash"))
    return R.upsert(X.shadow(spark, sf), fresh, "path")


@query("dec16_launch", """SELECT doc_id, doc_id % 2 = 0 AS start_sync, NOT (doc_id % 2 = 0 AND doc_id % 3 = 0) AS show_wizard, doc_id % 5 <> 0 AS single_instance, doc_id % 5 <> 0 AS updater, doc_id % 5 <> 0 AS autostart, doc_id % 5 <> 0 AS allow_wizard FROM documents""")
def dec16(spark, sf):
    """Every combination of the three facts."""
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", S.launch(d % 2 == 0, d % 3 == 0).alias("a"), S.plugin_policy(d % 5 == 0).alias("b"))
    return rows.select("doc_id", "a.*", "b.*")


@query("dec3_dec6_snk5_by_content", f"""WITH RECURSIVE {_CONTENT}, asked AS (SELECT root, secs, doc_id FROM de WHERE decision = 'R4_conflict'), {_ADMIT}
 SELECT de.doc_id, decision, {_GUARD} AS guard_arm, {_ALIGN} AS alignment, CASE WHEN decision NOT LIKE '%conflict%' THEN 'not_conflict' WHEN decision = 'R5_conflict' THEN 'skip_scope_suspect' WHEN NOT coalesce(admitted, true) THEN 'skip_breaker' ELSE 'stash_and_write' END AS outcome,
 {_REWRITE} AS rewrite FROM de LEFT JOIN ad ON ad.doc_id = de.doc_id""")
def dec3_dec4_dec6_snk5(spark, sf):
    """Guard, alignment, mint and compare-and-set on whole notes of both sides (X.sides), each test by its own function.

    Decisions compare pull forms. Conflicts that the store does not hold back go to the breaker in order of time.
    """
    rows = _contents(spark, sf)
    rows = stage(rows.select(
        "doc_id", "path", "root", "ts", "decision", F.col("shadow_hash").isNotNull().alias("known"), "strips", (C.body_only(F.col("local")) == C.body_only(F.col("server"))).alias("same_body"),
        (F.col("local") == F.col("server")).alias("raw_equal"), C.sha(F.col("local")).alias("seen"), C.sha(F.col("now")).alias("content_hash"),
    ), "content-sides")
    suspect = St.scope_suspect(rows.filter("known").select(F.col("path").alias("key")), ()).select(F.col("suspect").isNotNull().alias("suspect"))
    rows = rows.crossJoin(suspect)
    asked = rows.filter(F.col("decision").contains("conflict") & (F.col("known") | ~F.col("suspect"))).select("root", "ts", F.col("doc_id").alias("event_id"))
    admitted = O.admission(asked, 5, 6 * 3600).select(F.col("event_id").alias("doc_id"), "admitted")
    rows = rows.join(admitted, "doc_id", "left")
    d = F.col("decision")
    minted = R.mint(d, F.col("known"), F.col("suspect"), ~F.coalesce("admitted", F.lit(True)))
    out = R.compare_and_set(rows, F.col("seen"), F.col("strips")).withColumnRenamed("outcome", "rewrite")
    return out.select("doc_id", "decision", R.guard(d, F.col("strips"), F.col("same_body")).alias("guard_arm"), R.align(d, F.col("raw_equal")).alias("alignment"), minted.alias("outcome"), "rewrite")
