"""Keeping the losing bytes of conflicts beside their notes: one file for equal bytes, no file overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.operators import ordered as O


def _family(stash: Column) -> Column:
    """Folder, stem and mark of a conflict copy's path: copies of one note share it whatever their device and number."""
    name = P.basename(stash)
    return F.concat(F.left(stash, F.length(stash) - F.length(name)), F.substring_index(name, P.CONFLICT_MARK, 1), F.lit(P.CONFLICT_MARK))


def _slots(files: DataFrame) -> DataFrame:
    """(base, slot) that the paths of files take: a file is slot 1 of its own name, and slot n of the name that `-n` was put behind."""
    stem = F.regexp_extract("path", "(?s)^(.*)\\.md$", 1)
    n = F.regexp_extract(stem, "-([2-9]|[1-9][0-9]{1,8})$", 1)
    own = F.struct(F.col("path").alias("base"), F.lit(1).cast("long").alias("slot"))
    numbered = F.struct(F.concat(F.left(stem, F.length(stem) - F.length(n) - 1), F.lit(".md")).alias("base"), n.try_cast("long").alias("slot"))
    return files.filter(F.endswith("path", F.lit(".md"))).select(F.inline(F.when(n == "", F.array(own)).otherwise(F.array(own, numbered)))).distinct()


def place_stashes(losing: DataFrame, files: DataFrame, device: str) -> DataFrame:
    """Where the losing bytes of each row of `losing` (ord, path, lsn, content) are kept, as if row by row in the order of `ord`,
    beside the files (path, content) that lie there already.

    Adds stash, status and hashed. `reused`: a conflict copy of that note, of any device and number, holds these bytes already
    (several: the smallest path). `shared`: an earlier row of the same note brought them. `written`: a new file under the note's
    stash name, or that name with the first free number from 2. `refused`: the path is null or leads out of the folder; nothing
    is kept. `hashed` tells whether the name was too long and holds a hash of the path. A null number counts as 0, null bytes as
    none; `ord` names each row once. Bytes are compared by SHA-256.

    Nothing is sorted by note: equal bytes meet in a grouping with partial results, and free numbers are counted range by
    range, so a note with very many losing revisions is shared by all tasks. Contents are hashed where they are read and not shuffled.
    """
    lsn, p = F.coalesce(F.col("lsn"), F.lit(0)), P.fold_slashes(F.col("path"))
    stem = F.regexp_extract(P.basename(p), "(?s)^(.+?)(\\.[^.]*)?$", 1)
    safe = F.coalesce(P.is_safe(F.col("path")), F.lit(False))
    base = F.when(safe, P.stash_path(F.col("path"), F.lit(device), lsn))
    long = F.octet_length(F.concat(stem, F.lit(f"{P.CONFLICT_MARK}{device}-"), lsn.cast("string"), F.lit(".md"))) > P.NAME_LIMIT
    digest = lambda c: F.sha2(F.coalesce(F.col(c).cast("binary"), F.lit(b"")), 256)
    rows = losing.select("ord", "path", "lsn", digest("content").alias("sha"), base.alias("base"), (safe & long).alias("hashed")).withColumn("family", _family(F.col("base")))
    copies = files.filter(F.contains(P.basename(F.col("path")), F.lit(P.CONFLICT_MARK)) & F.endswith("path", F.lit(".md")))
    held = copies.select(_family(F.col("path")).alias("family"), digest("content").alias("sha"), "path").groupBy("family", "sha").agg(F.min("path").alias("there"))
    firsts = rows.filter("family IS NOT NULL").groupBy("family", "sha").agg(F.min(F.struct("ord", "base")).alias("first")).join(held, ["family", "sha"], "left")
    new = O.free_suffix(firsts.filter("there IS NULL").select("first.base", "first.ord"), _slots(files))
    name = F.when(F.col("slot") == 1, F.col("base")).otherwise(F.concat(F.left("base", F.length("base") - 3), F.lit("-"), F.col("slot").cast("string"), F.lit(".md")))
    new = new.select(F.col("ord").alias("first_ord"), name.alias("placed"))
    places = firsts.select("family", "sha", "there", F.col("first.ord").alias("first_ord")).join(new, "first_ord", "left")
    out = rows.join(places, ["family", "sha"], "left")
    status = F.when(F.col("family").isNull(), "refused").when(F.col("there").isNotNull(), "reused").when(F.col("ord") == F.col("first_ord"), "written").otherwise("shared")
    return out.select("ord", "path", "lsn", "sha", F.coalesce("there", "placed").alias("stash"), status.alias("status"), "hashed")


def manifest_rows(placed: DataFrame, device: str, ts: int) -> DataFrame:
    """What the manifest records: the files written under hashed names, which no longer tell their note (see stores.stash_manifest)."""
    new = placed.filter("status = 'written' AND hashed")
    return new.select(P.fold_slashes(F.col("path")).alias("original"), "stash", F.lit(device).alias("device"), F.coalesce("lsn", F.lit(0)).alias("lsn"), F.lit(ts).alias("ts"))


def new_files(placed: DataFrame, losing: DataFrame) -> DataFrame:
    """(path, content) of the files to write."""
    new = placed.filter("status = 'written'").select("ord", F.col("stash"))
    return losing.select("ord", "content").join(new, "ord").select(F.col("stash").alias("path"), F.coalesce(F.col("content").cast("binary"), F.lit(b"")).alias("content"))
