"""A folder tree walked on executors, level by level: entries, the tests that a scan applies to them, and hashes.

A level's directories are a table in the shared folder, cut into tasks; a task lists its directories and writes what it finds, and
the directories among that are the next level. The driver sees counts only. The tree must lie where all executors can open it as
files (a mounted share). Other file systems are read by `files.candidate_files`.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions.digests import resumed
from tidemark.plans.staging import shared_dir, stage

ENTRIES = "path STRING, at BINARY, kind STRING, size_bytes BIGINT, error STRING"
PARTS = "path STRING, at BINARY, size_bytes BIGINT, done BIGINT, state BINARY, content_hash STRING, error STRING"
COLUMNS = ["path", "at", "kind", "size_bytes", "error"]
ROWS = 10_000  # entries that a task holds before it hands them on
DIRECTORIES = 10_000  # directories that a task lists
PIECE = 1 << 16  # bytes that are hashed at once
TASK_BYTES = 1 << 28  # bytes of a file that a task hashes at once


def mounted(root: str) -> str:
    """The path of a folder that is given as such or as a file: address; others are refused."""
    at = urlsplit(root)
    if at.scheme not in ("", "file"):
        raise ValueError(f"only mounted folders are walked, not {at.scheme}:")
    return unquote(at.path) if at.scheme else root


def _lister(top: bytes) -> Callable:
    def name(at: bytes) -> str:
        return at[len(top) + 1 :].decode("utf-8", "replace")

    def row(e: os.DirEntry) -> tuple:
        try:
            kind = "link" if e.is_symlink() else "dir" if e.is_dir(follow_symlinks=False) else "file" if e.is_file(follow_symlinks=False) else "other"
            return name(e.path), e.path, kind, e.stat(follow_symlinks=False).st_size if kind == "file" else None, None
        except OSError as err:
            return name(e.path), e.path, "error", None, err.strerror

    def entries(at: bytes) -> Iterator[tuple]:
        if os.path.realpath(at) != at:  # a part of the path became a link after it was listed
            yield name(at), at, "escape", None, None
            return
        try:
            with os.scandir(at) as found:
                yield from map(row, found)
        except OSError as err:
            yield name(at), at, "error", None, err.strerror

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for at in (bytes(a) for b in batches for a in b["at"]):
            for e in entries(at):
                held.append(e)
                if len(held) == ROWS:
                    yield pd.DataFrame(held, columns=COLUMNS)
                    held = []
        yield pd.DataFrame(held, columns=COLUMNS).astype({"size_bytes": "Int64"})

    return listed


def list_level(directories: DataFrame, top: str) -> DataFrame:
    """The entries of the directories in column `at` (bytes of absolute paths below `top`); one that cannot be read is a row of kind error."""
    return directories.select("at").mapInPandas(_lister(os.fsencode(top)), ENTRIES)


def walk(spark: SparkSession, root: str) -> DataFrame:
    """Every entry below `root`: path (relative, with bytes that are no UTF-8 replaced), at (the bytes of its absolute path), kind,
    size_bytes of files, error.

    Kinds: file, dir, link, other (pipes, sockets), error (with the reason) and escape (a directory that turned into a link).
    Links are rows of their own and never followed, but for `root` itself. A missing root has no entries; a root that is a file is one error.
    """
    top = os.path.realpath(mounted(root))
    if not os.path.lexists(top):
        return spark.createDataFrame([], ENTRIES)
    base, levels = f"{shared_dir(spark)}/walk-{uuid.uuid4().hex}", []
    found = spark.createDataFrame([(bytearray(os.fsencode(top)),)], "at BINARY")
    while True:
        levels.append(f"{base}/{len(levels)}")
        list_level(found, top).write.parquet(levels[-1])
        found = spark.read.schema(ENTRIES).parquet(levels[-1]).filter("kind = 'dir'").select("at")
        n = found.count()
        if not n:
            return spark.read.schema(ENTRIES).parquet(*levels)
        # a number given keeps the tasks apart: rows are small here, the work behind them is not
        found = found.repartition(max(min(n, spark.sparkContext.defaultParallelism), -(-n // DIRECTORIES)), "at")


def outcome(excludes: Sequence[str] = P.EXCLUDES, allowed: Sequence[str] = (".md",), rules: Sequence[tuple[str, str, str]] = (), fence: bool = True) -> Column:
    """What a scan makes of a row of `walk`: take, or the first test that it fails; null for directories and what is no file."""
    p, kind = F.col("path"), F.col("kind")
    fenced = P.substrate_rule(p, rules).isNotNull() & F.lit(fence)
    tests = [
        (kind == "link", "symlink"),
        (kind.isin("error", "escape"), kind),
        (kind != "file", None),
        (P.excluded_by(p, excludes).isNotNull(), "exclude"),
        (P.conflict_parts(P.basename(p)).isNotNull(), "conflict_copy"),
        (P.is_junk(p), "junk"),
        (fenced, "substrate"),
        (~P.allowed_suffix(p, allowed), "extension"),
    ]
    out = F
    for test, label in tests:
        out = out.when(test, label if isinstance(label, Column) else F.lit(label))
    return out.otherwise("take")


def scan(spark: SparkSession, root: str, excludes: Sequence[str] = P.EXCLUDES, allowed: Sequence[str] = (".md",), rules: Sequence[tuple[str, str, str]] = (), fence: bool = True) -> DataFrame:
    """path, at, size_bytes, error and outcome of all that is not a directory, a pipe or a socket."""
    rows = walk(spark, root).withColumn("outcome", outcome(excludes, allowed, rules, fence))
    return rows.filter("outcome IS NOT NULL").drop("kind")


def _digests(follow: bool) -> Callable:
    def one(path: str, at: bytes, size: int, done: int, state: bytes | None) -> tuple:
        digest, end = resumed(state), done + TASK_BYTES if size - done > TASK_BYTES else None
        if digest is None:  # no state can be carried here: the file from its start to its end
            digest, done, end = hashlib.sha256(), 0, None
        try:
            # a file that turned into a link since the walk is not opened
            with open(os.open(bytes(at), os.O_RDONLY | (0 if follow else os.O_NOFOLLOW)), "rb") as f:
                f.seek(done)
                while piece := f.read(PIECE if end is None else min(PIECE, end - done)):
                    digest.update(piece)
                    done += len(piece)
                over = end is None or not f.read(1)
        except OSError as err:
            return path, at, size, None, None, None, err.strerror
        return (path, at, size, done, None, digest.hexdigest(), None) if over else (path, at, size, done, digest.state(), None, None)

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [one(p, a, n, int(d), s) for p, a, n, d, s in zip(b["path"], b["at"], b["size_bytes"], b["done"], b["state"])]
            yield pd.DataFrame(rows, columns=["path", "at", "size_bytes", "done", "state", "content_hash", "error"]).astype({"size_bytes": "Int64", "done": "Int64"})

    return hashed


def _dealt(files: DataFrame, total: int) -> DataFrame:
    """`files` (n, the bytes to read of each, `total` in all) in tasks of no more than about twice TASK_BYTES, whatever the sizes; at least as many tasks as run at once.

    Files of more than a 16th of a task's bytes are laid end to end and cut, which one task does with a row for each; smaller ones even out by hash.
    """
    share = max(1, min(TASK_BYTES, -(-total // files.sparkSession.sparkContext.defaultParallelism)))
    tasks, large = max(1, -(-total // share)), F.col("n") > share // 16
    ahead = F.sum("n").over(Window.orderBy("at", "path").rowsBetween(Window.unboundedPreceding, -1))
    laid = files.filter(large).withColumn("task", F.floor(F.coalesce(ahead, F.lit(0)) / share).cast("int"))
    strewn = files.filter(~large).withColumn("task", F.pmod(F.xxhash64("at"), F.lit(tasks)).cast("int"))
    return laid.unionByName(strewn).repartitionById(tasks, "task").drop("n", "task")


def hash_files(files: DataFrame, follow: bool = False) -> DataFrame:
    """path, content_hash, size_bytes, error of the files at `at`, read in pieces. One that cannot be read is a row with its error and no hash.
    Links are opened with `follow` only.

    Files are dealt to tasks by their bytes, as `size_bytes` has them. A task reads at most TASK_BYTES of a file: what is left goes on in a
    round of its own from the state of the digest so far, so a file of any size needs no task with all of it. `resumed` says where that cannot be.
    """
    size, out = F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), []
    rows = files.select("path", "at", size, F.lit(0).cast("long").alias("done"), F.lit(None).cast("binary").alias("state"))
    while True:
        left = F.greatest(F.col("size_bytes") - F.col("done"), F.lit(1))
        rows = rows.withColumn("n", F.least(left, F.lit(TASK_BYTES)).cast("long"))
        most, total = rows.agg(F.coalesce(F.max(left), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        hashed = _dealt(rows, total).mapInPandas(_digests(follow), PARTS)
        out.append(stage(hashed, "digests") if most > TASK_BYTES else hashed)
        if most <= TASK_BYTES:
            break
        rows = out[-1].filter("state IS NOT NULL").select("path", "at", "size_bytes", "done", "state")
    over = reduce(DataFrame.unionByName, (o.filter("state IS NULL") for o in out))
    return over.select("path", "content_hash", F.col("done").alias("size_bytes"), "error")


def manifest(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files that a scan takes (path, content_hash, size_bytes), and one row of counters: symlinks_skipped, substrate_refused_count,
    extension_filtered_count and errors, unreadable files among these. The order by path is the caller's."""
    hashed = hash_files(scanned.filter("outcome = 'take'"))
    n = lambda label: F.count(F.when(F.col("outcome") == label, 1))
    counted = scanned.agg(n("symlink").alias("symlinks_skipped"), n("substrate").alias("substrate_refused_count"), n("extension").alias("extension_filtered_count"), n("error").alias("walked"))
    counted = counted.crossJoin(hashed.agg(F.count("error").alias("unread")))
    counted = counted.select("symlinks_skipped", "substrate_refused_count", "extension_filtered_count", (F.col("walked") + F.col("unread")).alias("errors"))
    return hashed.filter("error IS NULL").drop("error"), counted


def write_tree(rows: DataFrame, root: str) -> None:
    """Write `content` (bytes) to `path` below a mounted folder, on executors; a row with `link` becomes a link to that target instead.

    Each file appears whole by a rename, so a task that runs again changes nothing. Rows of one path must agree.
    """
    top = mounted(root)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for b in batches:
            for path, content, link in zip(b["path"], b["content"], b["link"]):
                at = os.path.join(top, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                part = f"{top}/.part-{uuid.uuid4().hex}"
                if link is not None:
                    os.symlink(link, part)
                else:
                    with open(part, "wb") as f:
                        f.write(content)
                os.replace(part, at)
                n += 1
        yield pd.DataFrame({"n": [n]})

    os.makedirs(top, exist_ok=True)
    rows.select("path", "content", "link").mapInPandas(put, "n BIGINT").agg(F.sum("n")).collect()
