"""Journal files as numbered lines, read side by side.

Spark cuts large files into byte ranges at line ends, a task each. The lines of a range carry rising row ids, so a line's number is
its id less the first one of its range, plus the lines of the ranges ahead of it in the file. Only one row a range is
shuffled and summed; the lines themselves stay where they were read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import stores as St

LINES = "file STRING, line_no BIGINT, line STRING, file_bytes BIGINT"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1), line (without its end: LF, or CR and LF) and file_bytes of every line of every file below `path`.

    Bytes that are no UTF-8 are kept as they are (is_valid_utf8 tells). A missing path has no lines, and neither has an empty file.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], LINES)
    rows = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("file_bytes"), F.monotonically_increasing_id().alias("id"), "value")
    ranges = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    ranges = ranges.select("file", "at", (ahead + 1 - F.col("first")).alias("shift"))
    line = F.when(F.endswith("value", F.lit("\r")), F.left("value", F.length("value") - 1)).otherwise(F.col("value"))
    return rows.join(ranges, ["file", "at"]).select("file", (F.col("id") + F.col("shift")).alias("line_no"), line.alias("line"), "file_bytes")


def open_journal(spark: SparkSession, path: str, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """The live entries of every journal file below `path`, and the bytes of each (file, total_bytes). A missing path is an empty journal."""
    lines = numbered_lines(spark, path)
    sizes = lines.groupBy("file").agg(F.max("file_bytes").alias("total_bytes"))
    return St.journal_lines(lines, version), sizes
