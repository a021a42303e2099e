"""A folder of files as a manifest: listed, filtered by path first, and hashed where they pass."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.sources.folders import hash_files


def candidate_files(spark: SparkSession, root: str, roots: Sequence[str] = (), excludes: Sequence[str] = (), allowed: Sequence[str] = (".md",)) -> DataFrame:
    """path (relative), decision, rule, size_bytes and the lazily read content of every file below `root`; on mounted folders also at, the bytes of its absolute path.

    Only the columns asked for are read: a query that needs no content opens no file. A missing root has no files.
    Spark's reader of whole files lists files without a byte but gives no rows for them; they are added from its listing.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return spark.createDataFrame([], "path STRING, decision STRING, rule STRING, size_bytes BIGINT, content BINARY")
    lead = fs.makeQualified(top).toString().rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    known = spark.createDataFrame([(unquote(f).replace(":///", ":/", 1),) for f in rows.inputFiles()], "path STRING")
    empty = known.join(rows.select("path"), "path", "left_anti")
    rows = rows.select("path", "length", "content").unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))
    plain = lambda c: F.regexp_replace(c, "^[a-z]+:/+", "/")
    rel = F.substring(plain(F.col("path")), F.length(plain(F.lit(lead))) + 1, F.lit(1 << 30))
    rel = F.when(rel == "", P.basename(F.col("path"))).otherwise(rel)
    f = P.write_filter(rel, roots, excludes, allowed)
    at = [F.encode(plain(F.col("path")), "UTF-8").alias("at")] if lead.startswith("file:") else []
    return rows.select(rel.alias("path"), f["decision"].alias("decision"), f["rule"].alias("rule"), F.col("length").alias("size_bytes"), "content", *at)


def file_manifest(files: DataFrame) -> DataFrame:
    """path, content_hash, size_bytes of the files that pass, as the reconcile pass takes them. On mounted folders they are read in pieces, elsewhere whole."""
    files = files.filter("decision = 'allow'")
    if "at" not in files.columns:
        return files.select("path", F.sha2("content", 256).alias("content_hash"), "size_bytes")
    failed = F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("error")))
    return hash_files(files, follow=True).select("path", F.coalesce("content_hash", failed).alias("content_hash"), "size_bytes")
