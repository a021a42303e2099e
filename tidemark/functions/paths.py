"""Path identity, safety, scope and naming as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Default excludes (a prefix at the root or after any slash) and machine-local name prefixes.
EXCLUDES = (".obsidian/", ".trash/", "._/", "node_modules/")
LOCAL_PREFIXES = (".%",)
#: Names of folders, files and endings that are never content.
JUNK_DIRS = (".obsidian", ".trash", ".git", "node_modules", "__pycache__")
JUNK_NAMES = (".DS_Store", "Thumbs.db")
JUNK_ENDINGS = (".pyc", ".swp", ".tmp")
#: The marker of conflict copies, the byte limits of their names.
CONFLICT_MARK = ".conflict-from-"
NAME_LIMIT, PREFIX_BYTES = 250, 48
MANIFEST_NAME = ".conflict-manifest.jsonl"


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFC")


def fold_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def canonical_path(path: Column) -> Column:
    """NFC, then backslashes to slashes. ASCII paths never leave the JVM."""
    plain = F.length(path) == F.octet_length(path)
    return fold_slashes(F.when(plain, path).otherwise(_nfc(F.when(~plain, path))))


def strip_known_folder(path: Column, folders: Sequence[str]) -> Column:
    """Drop one leading folder if it is known and something remains."""
    head, rest = F.split_part(path, F.lit("/"), F.lit(1)), F.substring(path, F.locate("/", path) + 1, F.length(path))
    known = (F.locate("/", path) > 0) & head.isin(list(folders)) & (rest != "")
    return F.when(known, rest).otherwise(path)


def in_scope(path: Column, roots: Sequence[str], excludes: Sequence[str]) -> Column:
    """Raw prefixes without a segment boundary: excludes first, then no roots at all or any root."""
    out = any_of([F.startswith(path, F.lit(e)) for e in excludes])
    into = any_of([F.startswith(path, F.lit(r)) for r in roots]) if roots else F.lit(True)
    return ~out & into


def has_dotdot(path: Column) -> Column:
    return F.array_contains(F.split(path, "[/\\\\]"), "..")


def is_safe(path: Column) -> Column:
    lead = F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("\\"))
    drive = F.contains(path, F.lit(":\\")) | F.contains(path, F.lit(":/"))
    return ~(has_dotdot(path) | lead | drive)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def after_first_segment(path: Column) -> Column:
    at = F.locate("/", path)
    return F.when(at > 0, F.substring(path, at + 1, F.length(path)))


def extension(path: Column) -> Column:
    """Ending of the basename with its dot; a name that only starts with a dot has none."""
    return F.regexp_extract(basename(path), "^.+(\\.[^.]*)$", 1)


def excluded_by(path: Column, excludes: Sequence[str]) -> Column:
    """The first exclude that starts the path or follows a slash, else null."""
    hit = lambda e: F.startswith(path, F.lit(e)) | F.contains(path, F.lit("/" + e))
    return F.coalesce(*[F.when(hit(e), F.lit(e)) for e in excludes]) if excludes else F.lit(None).cast("string")


def is_junk(path: Column) -> Column:
    def bad(s: Column) -> Column:
        ends = any_of([F.endswith(s, F.lit(e)) for e in JUNK_ENDINGS])
        return F.startswith(s, F.lit("._")) | s.isin(*JUNK_NAMES, *JUNK_DIRS) | ends

    return F.exists(F.split(fold_slashes(path), "/"), bad)


def has_local_prefix(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: any_of([F.startswith(s, F.lit(p)) for p in LOCAL_PREFIXES]))


def allowed_suffix(path: Column, allowed: Sequence[str]) -> Column:
    return any_of([F.endswith(F.lower(path), F.lit(a.lower())) for a in allowed])


def conflict_parts(name: Column) -> Column:
    """(stem, device, lsn) of a conflict copy's name, null if it is none. A copy's own number is no lsn."""
    inner = F.when(F.endswith(name, F.lit(".md")), F.left(name, F.length(name) - 3))
    at = F.locate(CONFLICT_MARK, inner)
    stem, after = F.left(inner, at - 1), F.substring(inner, at + len(CONFLICT_MARK), F.length(inner))
    number = lambda s: F.when(F.rlike(s, F.lit("^\\+?[0-9]+$")), s.try_cast("decimal(20,0)"))
    twice = F.regexp_extract(after, "(?s)^(.+)-([^-]*)-([^-]*)$", 1), F.regexp_extract(after, "(?s)^(.+)-([^-]*)-([^-]*)$", 2)
    prefix, last = F.regexp_extract(after, "(?s)^(.+)-([^-]*)$", 1), F.regexp_extract(after, "(?s)^(.+)-([^-]*)$", 2)
    top = F.lit("18446744073709551615").cast("decimal(20,0)")
    valid = (at > 1) & (prefix != "") & (number(last) <= top)
    inner_ok = (twice[0] != "") & F.coalesce(number(twice[1]) <= top, F.lit(False))
    return F.when(
        valid,
        F.struct(stem.alias("stem"), F.when(inner_ok, twice[0]).otherwise(prefix).alias("device"), F.when(inner_ok, number(twice[1])).otherwise(number(last)).cast("string").alias("lsn")),
    )


def is_managed_artifact(path: Column) -> Column:
    name = basename(path)
    return F.contains(name, F.lit(CONFLICT_MARK)) | (name == MANIFEST_NAME)


def substrate_rule(path: Column, rules: Sequence[tuple[str, str, str]] = ()) -> Column:
    """Label of the first rule that hits the path or what follows its first segment; null with the empty default.

    Rules: ("name", file, ""), ("prefix", prefix, "") or ("scoped", prefix, file).
    """
    folded = fold_slashes(path)
    seen = [folded, F.coalesce(after_first_segment(folded), folded)]
    out = []
    for kind, a, b in rules:
        same = lambda p, n: F.lower(basename(p)) == n.lower()
        tests = {"name": [same(p, a) for p in seen], "prefix": [F.startswith(p, F.lit(a)) for p in seen], "scoped": [F.startswith(p, F.lit(a)) & same(p, b) for p in seen]}[kind]
        out.append(F.when(any_of(tests), F.lit(f"{kind}:{a}" + (f":{b}" if b else ""))))
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def write_filter(path: Column, roots: Sequence[str] = (), excludes: Sequence[str] = (), allowed: Sequence[str] = (".md",), rules: Sequence[tuple[str, str, str]] = (), managed: bool = True) -> Column:
    """(decision, rule): the first test that drops the path names itself."""
    p = fold_slashes(path)
    drop = lambda d, r: F.struct(F.lit(d).alias("decision"), (r if isinstance(r, Column) else F.lit(r)).cast("string").alias("rule"))
    base = excluded_by(p, EXCLUDES)
    own = F.coalesce(*[F.when(F.startswith(p, F.lit(e)), F.lit(e)) for e in excludes]) if excludes else F.lit(None).cast("string")
    rule = substrate_rule(p, rules)
    into = any_of([F.startswith(p, F.lit(r)) for r in roots]) if roots else F.lit(True)
    ext = F.lower(extension(p))
    return (
        F.when(F.startswith(p, F.lit("/")) | has_dotdot(p), drop("drop_out_of_scope", None))
        .when(base.isNotNull(), drop("drop_exclude", base))
        .when(has_local_prefix(p), drop("drop_exclude", "hardcoded-basename:.%"))
        .when(is_junk(p), drop("drop_exclude", "junk"))
        .when(conflict_parts(basename(p)).isNotNull(), drop("drop_exclude", "conflict-copy"))
        .when(is_managed_artifact(p) & F.lit(managed), drop("drop_exclude", "managed-conflict-artifact"))
        .when(own.isNotNull(), drop("drop_exclude", own))
        .when(~into, drop("drop_out_of_scope", None))
        .when(~ext.isin([a.lower() for a in allowed]), drop("drop_extension", ext))
        .when(rule.isNotNull(), drop("drop_substrate", rule))
        .otherwise(drop("allow", None))
    )


def sensitivity_class(path: Column) -> Column:
    """D for credentials and the two protocol folders, else C."""
    p = fold_slashes(path)
    low = F.lower(p)
    d = (basename(p) == "Credentials.md") | F.contains(low, F.lit("/credentials/")) | F.startswith(low, F.lit("credentials/"))
    d = d | F.contains(p, F.lit("02_Projects/Protocols/Infrastructure")) | F.contains(p, F.lit("02_Projects/Protocols/Bootstrap"))
    return F.when(d, F.lit("D")).otherwise(F.lit("C"))


@F.pandas_udf(StringType())
def _head_bytes(s: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else x.encode()[:k].decode(errors="ignore") for x, k in zip(s, n)])


def head_bytes(s: Column, n: int) -> Column:
    """At most n bytes, cut between characters."""
    plain = F.length(s) == F.octet_length(s)
    return F.when(plain, F.left(s, F.lit(n))).otherwise(_head_bytes(F.when(~plain, s), F.lit(n)))


def stash_name(path: Column, stem: Column, device: Column, lsn: Column) -> Column:
    """Name of a conflict copy; long ones keep a head of the stem and 16 hex digits of the path's hash."""
    tail = F.concat(F.lit(CONFLICT_MARK), device, F.lit("-"), lsn.cast("string"), F.lit(".md"))
    natural = F.concat(stem, tail)
    # UTF-16 units never outnumber UTF-8 bytes, so the byte test covers both limits
    return F.when(F.octet_length(natural) <= NAME_LIMIT, natural).otherwise(F.concat(head_bytes(stem, PREFIX_BYTES), F.lit("."), F.left(F.sha2(path.cast("binary"), 256), F.lit(16)), tail))


def stash_path(path: Column, device: Column, lsn: Column) -> Column:
    p = fold_slashes(path)
    parent = F.left(p, F.length(p) - F.length(basename(p)))
    stem = F.regexp_extract(basename(p), "(?s)^(.+?)(\\.[^.]*)?$", 1)
    return F.concat(parent, stash_name(path, stem, device, lsn))


def is_unresolved(path: Column) -> Column:
    """A name that holds the mark of a conflict copy and ends .md; looser than conflict_parts."""
    name = basename(fold_slashes(path))
    return F.contains(name, F.lit(CONFLICT_MARK)) & F.endswith(name, F.lit(".md"))


def original_of(path: Column) -> Column:
    """The path that a conflict copy was made of."""
    p = fold_slashes(path)
    return F.concat(F.left(p, F.length(p) - F.length(basename(p))), conflict_parts(basename(p))["stem"], F.lit(".md"))


def relative_to(path: Column, root: str) -> Column:
    """An absolute path below `root` without it; null elsewhere."""
    lead = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(lead)), F.substring(path, len(lead) + 1, 1 << 30))


def is_mutating(kind: Column) -> Column:
    """Whether a file event may change content: all kinds but `access` and `modify/metadata` with what lies below them; unknown ones do."""
    k = F.lower(F.coalesce(kind, F.lit("any")))
    below = lambda p: (k == p) | F.startswith(k, F.lit(p + "/"))
    return ~(below("access") | below("modify/metadata"))


def target_path(mode: Column, rel: Column, live_root: Column, shadow_root: Column) -> Column:
    """Where a path is written: below the live root in live mode, below the shadow's in every other, unknown and null ones too."""
    root = F.when(mode == "live", live_root).otherwise(shadow_root)
    return F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"), rel)


def is_redflag(path: Column, is_file: Column) -> Column:
    """The stop flag: a regular file of exactly this name at the root."""
    return (path == "redflag.md") & is_file
