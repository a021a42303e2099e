"""Tables written between the steps of a long plan.

They lie in the folder that the session names in ``spark.checkpoint.dir``, which all executors share, so a lost
executor never takes an intermediate result with it. The folder is removed when the driver's JVM ends.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this application. Where the session names none, a folder of our own, but only on one machine: on a
    cluster every executor would write to its own disk, so that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hpath)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write `df` once and read it back: cuts the lineage and fixes the rows that later steps see."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the shuffle files of steps that are over removed: Spark keeps them until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
