"""Path predicates, cascades and names over derived paths (PRED, PROJ, SCL-1/2/14..17, SRC-12..14 rows)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.operators import reconcile as R
from tidemark.operators import ordered as O
from tidemark.plans.guard_queries import _BURST
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.fixtures import with_sql
from tidemark.sources.tables import table

ROOTS, OUT = ("src1", "src2", "credentials/"), ("src11",)
_P = "replace(path, '\\', '/')"
_BASE = f"split_part({_P}, '/', -1)"
_DOT = "list_contains(regexp_split_to_array(path, '[/\\\\]'), '..')"
_SAFE = f"NOT ({_DOT} OR starts_with(path, '/') OR starts_with(path, '\\') OR contains(path, ':\\') OR contains(path, ':/'))"
_ROOT = "(starts_with({0}, 'src1') OR starts_with({0}, 'src2') OR starts_with({0}, 'credentials/'))"
_JUNK = f"len(list_filter(string_split({_P}, '/'), lambda s: starts_with(s, '._') OR s IN ('.DS_Store', 'Thumbs.db', '.obsidian', '.trash', '.git', 'node_modules', '__pycache__') OR suffix(s, '.pyc') OR suffix(s, '.swp') OR suffix(s, '.tmp'))) > 0"
_LOCAL = f"len(list_filter(string_split({_P}, '/'), lambda s: starts_with(s, '.%'))) > 0"
_EXCL = "coalesce(" + ", ".join(f"CASE WHEN starts_with({_P}, '{e}') OR contains({_P}, '/{e}') THEN '{e}' END" for e in P.EXCLUDES) + ")"
_EXT = f"regexp_extract({_BASE}, '^.+(\\.[^.]*)$', 1)"
_INNER = f"CASE WHEN suffix({_BASE}, '.md') THEN left({_BASE}, length({_BASE}) - 3) END"
_CONF = f"""(SELECT CASE WHEN strpos(x, '.conflict-from-') > 1 AND pre <> '' AND TRY_CAST(CASE WHEN regexp_full_match(l1, '\\+?[0-9]+') THEN l1 END AS DECIMAL(38,0)) <= 18446744073709551615
   THEN {{'stem': left(x, strpos(x, '.conflict-from-') - 1), 'device': CASE WHEN two THEN dev ELSE pre END, 'lsn': CASE WHEN two THEN CAST(TRY_CAST(l2 AS DECIMAL(38,0)) AS VARCHAR) ELSE CAST(TRY_CAST(l1 AS DECIMAL(38,0)) AS VARCHAR) END}} END
  FROM (SELECT x, regexp_extract(a, '^(.+)-([^-]*)$', 1) AS pre, regexp_extract(a, '^(.+)-([^-]*)$', 2) AS l1, regexp_extract(a, '^(.+)-([^-]*)-([^-]*)$', 1) AS dev, regexp_extract(a, '^(.+)-([^-]*)-([^-]*)$', 2) AS l2,
    coalesce(regexp_extract(a, '^(.+)-([^-]*)-([^-]*)$', 1) <> '' AND TRY_CAST(CASE WHEN regexp_full_match(regexp_extract(a, '^(.+)-([^-]*)-([^-]*)$', 2), '\\+?[0-9]+') THEN regexp_extract(a, '^(.+)-([^-]*)-([^-]*)$', 2) END AS DECIMAL(38,0)) <= 18446744073709551615, false) AS two
   FROM (SELECT x, substr(x, strpos(x, '.conflict-from-') + 15) AS a FROM (SELECT {_INNER} AS x))))"""


def _paths(spark, sf):
    return X.paths(spark, sf)


@query("pred1_to_pred11_paths", with_sql(f"""SELECT doc_id, path, NOT starts_with(path, 'src11') AND {_ROOT.format('path')} AS in_scope, {_DOT} AS dotdot, {_SAFE} AS safe, {_EXCL} AS excluded_by, {_JUNK} AS junk,
  suffix(lower(path), '.md') AS suffix_ok, {_CONF} IS NOT NULL AS conflict_copy, contains({_BASE}, '.conflict-from-') OR {_BASE} = '.conflict-manifest.jsonl' AS managed, {_LOCAL} AS local_name,
  CASE WHEN {_BASE} = 'Credentials.md' OR contains(lower({_P}), '/credentials/') OR starts_with(lower({_P}), 'credentials/') OR contains({_P}, '02_Projects/Protocols/Infrastructure') OR contains({_P}, '02_Projects/Protocols/Bootstrap') THEN 'D' ELSE 'C' END AS class
  FROM paths""", "paths"))
def pred1_to_pred10_pred18(spark, sf):
    p = F.col("path")
    q = P.fold_slashes(p)
    return _paths(spark, sf).select(
        "doc_id", "path", P.in_scope(p, ROOTS, OUT).alias("in_scope"), P.has_dotdot(p).alias("dotdot"), P.is_safe(p).alias("safe"), P.excluded_by(q, P.EXCLUDES).alias("excluded_by"),
        P.is_junk(p).alias("junk"), P.allowed_suffix(p, [".md"]).alias("suffix_ok"), P.conflict_parts(P.basename(q)).isNotNull().alias("conflict_copy"),
        P.is_managed_artifact(q).alias("managed"), P.has_local_prefix(q).alias("local_name"), P.sensitivity_class(p).alias("class"),
    )


_RULE = f"CASE WHEN lower({_BASE}) = 'credentials.md' THEN 'name:Credentials.md' WHEN (starts_with({_P}, 'src3/rules/') OR starts_with(CASE WHEN contains({_P}, '/') THEN substr({_P}, strpos({_P}, '/') + 1) ELSE {_P} END, 'src3/rules/')) THEN 'prefix:src3/rules/' WHEN (starts_with({_P}, 'rules/') OR starts_with(CASE WHEN contains({_P}, '/') THEN substr({_P}, strpos({_P}, '/') + 1) ELSE {_P} END, 'rules/')) AND lower({_BASE}) = 'en.md' THEN 'scoped:rules/:en.md' END"
RULES = (("name", "Credentials.md", ""), ("prefix", "src3/rules/", ""), ("scoped", "rules/", "en.md"))
_CASCADE = f"""CASE WHEN starts_with({_P}, '/') OR list_contains(string_split({_P}, '/'), '..') THEN 'drop_out_of_scope|' WHEN {_EXCL} IS NOT NULL THEN 'drop_exclude|' || {_EXCL} WHEN {_LOCAL} THEN 'drop_exclude|hardcoded-basename:.%' WHEN {_JUNK} THEN 'drop_exclude|junk'
  WHEN {_CONF} IS NOT NULL THEN 'drop_exclude|conflict-copy' WHEN contains({_BASE}, '.conflict-from-') OR {_BASE} = '.conflict-manifest.jsonl' THEN 'drop_exclude|managed-conflict-artifact' WHEN starts_with({_P}, 'src11') THEN 'drop_exclude|src11'
  WHEN NOT (starts_with({_P}, 'src') OR {_ROOT.format(_P)}) THEN 'drop_out_of_scope|' WHEN lower({_EXT}) <> '.md' THEN 'drop_extension|' || lower({_EXT}) WHEN {_RULE} IS NOT NULL THEN 'drop_substrate|' || {_RULE} ELSE 'allow|' END"""


@query("pred12_write_filter", with_sql(f"SELECT doc_id, split_part({_CASCADE}, '|', 1) AS decision, nullif(substr({_CASCADE}, strpos({_CASCADE}, '|') + 1), CASE WHEN {_CASCADE} LIKE '%out_of_scope|' OR {_CASCADE} = 'allow|' THEN '' END) AS rule FROM paths", "paths"))
def pred12_pred4_ord6(spark, sf):
    """With a rule list, to exercise PRED-4; the default list is empty."""
    f = P.write_filter(F.col("path"), ("src", *ROOTS), OUT, (".md",), RULES)
    return _paths(spark, sf).withColumn("f", f).select("doc_id", "f.decision", "f.rule")


def _watched(spark, sf):
    """File events: kinds by event type, resets now and then, paths and new paths of the shapes of X.PATHS."""
    e, n = table(spark, sf, "events"), F.col("event_id")
    parts = {"{s}": F.concat(F.lit("src"), (F.col("user_id") % 3).cast("string")), "{l}": F.lit("en"), "{d}": n.cast("string")}
    kind = F.when(n % 97 == 0, "reset").when(n % 5 == 0, "rename").when(n % 2 == 0, "delete").when(n % 3 == 0, "create").otherwise("modify")
    good = "{s}/{l}/{d}.md"
    path = F.when(n % 3 == 0, X.pick(X.PATHS, F.floor(n / 3), parts)).otherwise(X.pick((good,), n, parts))
    new = F.when(n % 4 == 0, X.pick(X.PATHS, F.floor(n / 4), parts)).otherwise(X.pick((good,), n, parts))
    return e.select(n, "ts", (F.col("user_id") % 8).alias("root"), kind.alias("kind"), path.alias("path"), F.when(kind == "rename", new).alias("new_path"))


def _shape(n: str) -> str:
    return f"replace(replace(replace({X._sql_list(X.PATHS)}[{n} % {len(X.PATHS)} + 1], '{{s}}', 'src' || user_id % 3), '{{l}}', 'en'), '{{d}}', event_id::VARCHAR)"


_GOOD = "'src' || user_id % 3 || '/en/' || event_id || '.md'"
#: The gates of both paths, the valve over deletes that pass them, and the answer to each event.
_CLASSIFIED = f"""ev AS (SELECT event_id, ts, user_id % 8 AS root, CASE WHEN event_id % 97 = 0 THEN 'reset' WHEN event_id % 5 = 0 THEN 'rename' WHEN event_id % 2 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'create' ELSE 'modify' END AS kind,
  CASE WHEN event_id % 3 = 0 THEN {_shape('(event_id // 3)')} ELSE {_GOOD} END AS old_path, CASE WHEN event_id % 4 = 0 THEN {_shape('(event_id // 4)')} ELSE {_GOOD} END AS new_path FROM events),
 si AS (SELECT event_id, 'old' AS side, old_path AS path FROM ev WHERE kind <> 'reset' UNION ALL SELECT event_id, 'new', new_path FROM ev WHERE kind = 'rename'),
 ca AS (SELECT event_id, side, {_CASCADE} AS c FROM si),
 ga AS (SELECT event_id, side, split_part(c, '|', 1) AS decision, nullif(substr(c, strpos(c, '|') + 1), CASE WHEN c LIKE '%out_of_scope|' OR c = 'allow|' THEN '' END) AS rule FROM ca),
 fi AS (SELECT event_id, arg_min(struct_pack(d := decision, r := rule, s := side), side <> 'old') AS f FROM ga WHERE decision <> 'allow' GROUP BY event_id),
 gt AS (SELECT ev.*, coalesce(f.d, 'allow') AS gate, f.r AS rule, f.s AS side FROM ev LEFT JOIN fi ON fi.event_id = ev.event_id),
 burst_events AS (SELECT event_id, ts, root, kind = 'reset' AS is_reset FROM gt WHERE kind = 'reset' OR kind = 'delete' AND gate = 'allow'), {_BURST},
 cl AS (SELECT gt.event_id, gt.root, gt.kind, CASE WHEN kind = 'reset' THEN CASE WHEN paused THEN 'resumed' ELSE 'not_paused' END WHEN paused THEN 'drop_delete_burst' ELSE gate END AS decision, rule, side FROM gt LEFT JOIN v ON v.event_id = gt.event_id)"""


def _classified(spark, sf):
    return O.classify(_watched(spark, sf), 3, "6 HOURS", roots=("src", *ROOTS), excludes=OUT, rules=RULES)


@query("pred13_fn7_classify", f"WITH {_CLASSIFIED} SELECT * FROM cl")
def pred13_fn7(spark, sf):
    return _classified(spark, sf).select("event_id", "root", "kind", "decision", "rule", "side")


@query("agg5_drop_counts", f"""WITH {_CLASSIFIED} SELECT root, count(*) FILTER (WHERE decision = 'drop_substrate') AS dropped_substrate, count(*) FILTER (WHERE decision = 'drop_extension') AS dropped_extension,
 count(*) FILTER (WHERE decision IN ('drop_exclude', 'drop_out_of_scope')) AS dropped_excludes, count(*) FILTER (WHERE starts_with(decision, 'drop_')) AS filtered FROM cl GROUP BY root""")
def agg5(spark, sf):
    return O.drop_counts(_classified(spark, sf), "root")


@query("pred13_renames", with_sql(f"SELECT a.doc_id, a.ok AND b.ok AS allowed FROM (SELECT doc_id, {_CASCADE} = 'allow|' AS ok FROM paths) a JOIN (SELECT doc_id, {_CASCADE} = 'allow|' AS ok FROM paths) b ON b.doc_id = a.doc_id + 1", "paths"))
def pred13(spark, sf):
    """A rename passes only where both of its sides pass every gate."""
    a = _paths(spark, sf)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("new"))
    ok = lambda c: P.write_filter(F.col(c), ("src", *ROOTS), OUT, (".md",), RULES)["decision"] == "allow"
    return a.join(b, "doc_id").select("doc_id", (ok("path") & ok("new")).alias("allowed"))


#: Kinds of file events, in any case and to any depth, and whether they may change content.
_KINDS = (("create", True), ("remove/file", True), ("modify/data", True), ("modify/name", True), ("Modify/Metadata", False), ("modify/metadata/permissions", False), ("access", False), ("ACCESS/open", False), ("any", True), ("other", True), ("accessory", True), (None, True))
_FEED = ("enrichment_complete", "lint_complete", "", None)
_SQL_KINDS = "[" + ", ".join("NULL" if k is None else f"'{k}'" for k, _ in _KINDS) + "]"


@query("pred11_pred16_kinds", f"""SELECT event_id, {_SQL_KINDS}[event_id % {len(_KINDS)} + 1] AS kind, [{', '.join(str(m).lower() for _, m in _KINDS)}][event_id % {len(_KINDS)} + 1] AS mutating, (event_id // {len(_KINDS)}) % 4 = 0 AS finished FROM events""")
def pred11_pred16(spark, sf):
    """Every kind with every phase of the feed."""
    e = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))
    rows = table(spark, sf, "events").select("event_id", pick([k for k, _ in _KINDS], e).alias("kind"), pick(_FEED, F.floor(e / len(_KINDS))).alias("phase"))
    return rows.select("event_id", "kind", P.is_mutating(F.col("kind")).alias("mutating"), S.is_finished(F.col("phase")).alias("finished"))


@query("pred15_backfill_filter", with_sql(f"SELECT doc_id, doc_id % 2 = 0 AND {_SAFE} AND {_RULE} IS NULL AS pull FROM paths", "paths"))
def pred15(spark, sf):
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", ((F.col("doc_id") % 2 == 0) & P.is_safe(p) & P.substrate_rule(p, RULES).isNull()).alias("pull"))


@query("scl1_scl2_scl17_identity", with_sql(f"""WITH c AS (SELECT doc_id, replace(nfc_normalize(path), '\\', '/') AS p FROM paths)
  SELECT doc_id, p AS canonical, CASE WHEN contains(p, '/') AND split_part(p, '/', 1) IN ('src0', 'src1', 'src2') AND substr(p, strpos(p, '/') + 1) <> '' THEN substr(p, strpos(p, '/') + 1) ELSE p END AS key,
  split_part(p, '/', -1) AS base, regexp_extract(split_part(p, '/', -1), '^.+(\\.[^.]*)$', 1) AS ext, CASE WHEN contains(p, '/') THEN substr(p, strpos(p, '/') + 1) END AS rest FROM c""", "paths"))
def scl1_scl2_scl17_fn9(spark, sf):
    c = _paths(spark, sf).select("doc_id", P.canonical_path(F.col("path")).alias("canonical"))
    p = F.col("canonical")
    return c.select("doc_id", "canonical", P.strip_known_folder(p, X.FOLDERS).alias("key"), P.basename(p).alias("base"), P.extension(p).alias("ext"), P.after_first_segment(p).alias("rest"))


@query("scl16_src12_conflicts", with_sql(f"SELECT doc_id, path, c.stem, c.device, c.lsn, left({_P}, length({_P}) - length({_BASE})) || c.stem || '.md' AS original FROM (SELECT *, {_CONF} AS c FROM paths) WHERE c IS NOT NULL", "paths"))
def scl16_src12_join11_pred8(spark, sf):
    rows = _paths(spark, sf).withColumn("c", P.conflict_parts(P.basename(P.fold_slashes(F.col("path"))))).filter("c IS NOT NULL")
    return rows.select("doc_id", "path", "c.stem", "c.device", "c.lsn", P.original_of(F.col("path")).alias("original"))


@query("src13_unresolved", with_sql(f"SELECT count(*)::BIGINT AS n FROM paths WHERE contains({_BASE}, '.conflict-from-') AND suffix({_BASE}, '.md')", "paths"))
def src13_fn5(spark, sf):
    return _paths(spark, sf).agg(F.count_if(P.is_unresolved(F.col("path"))).alias("n"))


@query("src14_folders", with_sql("SELECT split_part(path, '/', 1) AS folder, bool_or(split_part(path, '/', 2) = 'node_modules') AS has_app FROM paths WHERE contains(path, '/') AND NOT starts_with(path, '.') AND split_part(path, '/', 1) <> '' GROUP BY 1", "paths"))
def src14_ord4(spark, sf):
    return R.folders(_paths(spark, sf), "node_modules")


@query("scl14_scl15_stash_names", """WITH s AS (SELECT doc_id, source || '/' || repeat(lang, (1 + doc_id % 130)::INT) || '.md' AS path, repeat(lang, (1 + doc_id % 130)::INT) AS stem FROM documents)
  SELECT doc_id, split_part(path, '/', 1) || '/' || CASE WHEN strlen(stem || '.conflict-from-dev-a-' || doc_id || '.md') <= 250 THEN stem || '.conflict-from-dev-a-' || doc_id || '.md'
  ELSE left(stem, 48) || '.' || left(sha256(path), 16) || '.conflict-from-dev-a-' || doc_id || '.md' END AS stash FROM s""")
def scl14_scl15(spark, sf):
    d = table(spark, sf, "documents")
    path = F.concat("source", F.lit("/"), F.expr("repeat(lang, cast(1 + doc_id % 130 AS int))"), F.lit(".md"))
    return d.select("doc_id", P.stash_path(path, F.lit(X.DEVICE), F.col("doc_id")).alias("stash"))


@query("join10_identical_stash", """WITH s AS (SELECT 'n' || (doc_id % 50) AS stem, sha256(lang) AS sha FROM documents WHERE doc_id % 4 = 0) SELECT doc_id, stem, sha FROM (SELECT doc_id, 'n' || (doc_id % 60) AS stem, sha256(lang) AS sha FROM documents) w
  WHERE EXISTS (SELECT 1 FROM s WHERE s.stem = w.stem AND s.sha = w.sha)""")
def join10(spark, sf):
    d = table(spark, sf, "documents")
    stem = lambda n: F.concat(F.lit("n"), (F.col("doc_id") % n).cast("string"))
    have = d.filter("doc_id % 4 = 0").select(stem(50).alias("stem"), F.sha2("lang", 256).alias("sha"))
    wanted = d.select("doc_id", stem(60).alias("stem"), F.sha2("lang", 256).alias("sha"))
    return R.unseen_stashes(wanted, have, "stem", "sha")[0].select("doc_id", "stem", "sha")


@query("join12_preserve_bytes", with_sql("SELECT j.event_id, l.content_hash IS DISTINCT FROM j.content_sha AS stash FROM journal j LEFT JOIN (SELECT path, sha256(path) AS content_hash FROM (SELECT DISTINCT path FROM journal) WHERE path <> 'notes/3.md') l ON j.path = l.path", "journal"))
def join12(spark, sf):
    """Pushed bytes are stashed where the file differs or is gone."""
    j = X.journal(spark, sf)
    files = j.select("path").distinct().filter("path <> 'notes/3.md'").withColumn("content_hash", F.sha2("path", 256))
    return R.preserve_bytes(j, files).select("event_id", "stash")


@query("proj1_push_events", """SELECT event_id, 'n' || user_id || CASE WHEN event_id % 5 = 3 THEN '-new.md' ELSE '.md' END AS path, ['create', 'modify', 'delete', 'create'][event_id % 5 + 1] AS action,
 CASE WHEN event_id % 5 = 2 THEN '' ELSE sha256(props) END AS content_sha, NULL::VARCHAR AS base_hash, 'dev-a' AS device_id FROM events WHERE event_id % 5 <> 4 AND (event_id % 5 = 2 OR event_id % 9 <> 0)""")
def proj1(spark, sf):
    """Created, modified, deleted and renamed files, and a kind that is not known; every ninth has no content to read."""
    e = F.col("event_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in ("created", "modified", "deleted", "renamed", "odd")]), (e % 5 + 1).cast("int"))
    name = F.concat(F.lit("n"), F.col("user_id").cast("string"))
    events = table(spark, sf, "events").select(
        "event_id", kind.alias("kind"), F.concat(name, F.lit(".md")).alias("path"), F.concat(name, F.lit("-new.md")).alias("new_path"), F.when(e % 9 != 0, F.col("props")).alias("content"), F.col("ts").alias("queued_at"),
    )
    return R.push_events(events, X.DEVICE).drop("queued_at")


@query("proj3_relative", with_sql("SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN path END AS rel FROM paths", "paths"))
def proj3(spark, sf):
    absolute = F.concat(F.when(F.col("doc_id") % 3 > 0, F.lit("/vault/")).otherwise(F.lit("/vaults/")), "path")
    return _paths(spark, sf).select("doc_id", P.relative_to(absolute, "/vault").alias("rel"))


_MODES = ("live", "disabled", "shadow", "LIVE", "", None)


@query("fn4_targets", "SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '/vaults/' ELSE '/state/shadow/' END || source || '/' || doc_id || '.md' AS target FROM documents")
def fn4(spark, sf):
    """Mode to root; an unknown mode is the shadow's."""
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("doc_id") % 6 + 1).cast("int"))
    rel = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf, "documents").select("doc_id", P.target_path(mode, rel, F.lit("/vaults"), F.lit("/state/shadow/")).alias("target"))


@query("dec18_redflag", """SELECT source, bool_or(doc_id % 40 = 0) AS tripped FROM documents GROUP BY source""")
def dec18(spark, sf):
    """By folder: only a regular file of the exact name trips; folders, other cases and deeper files do not."""
    d = F.col("doc_id")
    name = F.when(d % 20 == 0, "redflag.md").when(d % 20 == 1, "Redflag.md").when(d % 20 == 2, "a/redflag.md").otherwise("redflag.md.txt")
    rows = table(spark, sf, "documents").select("source", P.is_redflag(name, d % 40 != 20).alias("hit"))
    return rows.groupBy("source").agg(F.bool_or("hit").alias("tripped"))
