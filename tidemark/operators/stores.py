"""Journal lines and keyed stores kept as JSON: reading, key migration, lineage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.functions import scalars as S
from tidemark.functions.bind import bind

#: Fixed value: white space of all scripts, as a Java class.
_BLANK = "^[\\s\\x0B\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]*$"


#: Times as RFC 3339 writes them.
_INSTANT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"
_BASE64 = "^([A-Za-z0-9+/]{4})*([A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"


def journal_lines(lines: DataFrame, version: int = 1) -> DataFrame:
    """Live entries of (file, line_no, line): blank lines are passed over; the first line that is no UTF-8, no single JSON object, or without a
    whole number from 0 to 2**32 - 1 as its version ends a file; other versions, and bodies with a field missing or of a wrong type, are
    skipped; a missing or empty id becomes a hash of the entry.

    A line is parsed once, to a variant, inside an array that its own digest ends: text behind the object never reads as that.
    """
    mark = F.md5(F.col("line").cast("binary"))
    t = lines.filter(~F.rlike("line", F.lit(_BLANK)) | ~F.is_valid_utf8("line")).select("file", "line_no", "line")
    whole = F.when(F.is_valid_utf8("line"), F.concat(F.lit('[{"e":'), "line", F.lit('},"'), mark, F.lit('"]')))
    t = bind(t, "v", F.call_function("try_parse_json", whole)).withColumn("mark", mark).drop("line")
    kind = lambda at: F.call_function("schema_of_variant", F.call_function("variant_get", F.col("v"), F.lit(f"$[0].e.{at}")))
    get = lambda at, to="string": F.call_function("try_variant_get", F.col("v"), F.lit(f"$[0].e.{at}"), F.lit(to))
    single = F.call_function("try_variant_get", F.col("v"), F.lit("$[1]"), F.lit("string")) == F.col("mark")
    number = F.when(single & (kind("schema_version") == "BIGINT"), get("schema_version", "bigint"))
    fields = F.struct(
        F.when(number.between(0, (1 << 32) - 1), number).alias("version"),
        *[get(c).alias(c) for c in ("id", "path", "action", "base_hash", "content_sha", "queued_at", "device_id", "content_bytes")],
        *[kind(c).alias(f"{c}_kind") for c in ("id", "path", "action", "base_hash", "content_sha", "queued_at", "device_id", "content_bytes")],
        get("content_bytes", "array<bigint>").alias("numbers"),
    )
    t = bind(t, "e", fields).select("file", "line_no", "e.*")
    stops = t.filter("version IS NULL").groupBy("file").agg(F.min("line_no").alias("stop"))
    kept = t.filter(F.col("version") == version).join(stops, "file", "left").filter("stop IS NULL OR line_no < stop")
    text = lambda *names: reduce(lambda a, b: a & b, [F.col(f"{c}_kind") == "STRING" for c in names])
    absent = lambda c: F.col(f"{c}_kind").isNull() | (F.col(f"{c}_kind") == "VOID")
    at = F.col("queued_at").try_cast("timestamp")
    raw = F.coalesce(F.forall("numbers", lambda x: x.between(0, 255)), F.lit(False)) & (F.col("content_bytes_kind").isin("ARRAY<BIGINT>", "ARRAY<VOID>"))
    right = (
        text("path", "action", "content_sha", "queued_at", "device_id") & F.col("action").isin("create", "modify", "delete") & F.rlike("queued_at", F.lit(_INSTANT)) & at.isNotNull()
        & (F.col("id_kind").isNull() | text("id")) & (absent("base_hash") | text("base_hash")) & (absent("content_bytes") | text("content_bytes") & F.rlike("content_bytes", F.lit(_BASE64)) | raw)
    )
    own = F.when(F.coalesce(F.col("id"), F.lit("")) == "", S.legacy_id("path", "content_sha", F.unix_micros(at).cast("string"), "action")).otherwise(F.col("id"))
    return kept.filter(right).select("file", "line_no", own.alias("id"), "path", "action", "base_hash", "content_sha")


def nack(journal: DataFrame, ids: DataFrame) -> DataFrame:
    """A refused line stays where it is, to be drained again."""
    return journal


def ack(journal: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The journal without the lines of `ids`; ids that it does not hold change nothing."""
    return journal.join(ids.select(key), key, "left_anti")


def stash_manifest(stashes: DataFrame) -> DataFrame:
    """line: one JSON object for each stash (original, stash, device, lsn, ts), paths with forward slashes."""
    return stashes.select(F.to_json(F.struct("original", P.fold_slashes(F.col("stash")).alias("stash"), "device", F.col("lsn").cast("long").alias("lsn"), F.col("ts").cast("long").alias("ts"))).alias("line"))


def record_stash_manifest(stashes: DataFrame, folder: str) -> None:
    """Append the lines to a folder of text files, which concurrent writers may share."""
    stash_manifest(stashes).write.mode("append").text(folder)


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, folder: str) -> int | None:
    """The number of the version that the pointer names."""
    path, fs = _files(spark, folder)
    found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n.removeprefix("current-")) for n in found if n.startswith("current-")), default=None)


def save(store: DataFrame, folder: str) -> int:
    """Rewrite a store whole: its rows go to a new version, and then one empty file names that version current. So a reader
    sees the old rows or the new ones, and a run that fails leaves the old."""
    spark = store.sparkSession
    number = (_version(spark, folder) or 0) + 1
    store.write.mode("overwrite").parquet(f"{folder}/v{number}")
    path, fs = _files(spark, f"{folder}/current-{number}")
    fs.create(path, True).close()
    return number


def load(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The current version of a store; a missing one is empty."""
    number = _version(spark, folder)
    return spark.createDataFrame([], schema) if number is None else spark.read.schema(schema).parquet(f"{folder}/v{number}")


def save_if_changed(store: DataFrame, folder: str, schema: str) -> bool:
    """save(), unless the current version has the same rows."""
    old = load(store.sparkSession, folder, schema)
    marked = old.select(*old.columns, F.lit(1).alias("n")).unionByName(store.select(*old.columns, F.lit(-1).alias("n")))
    if _version(store.sparkSession, folder) is not None and marked.groupBy(*old.columns).agg(F.sum("n").alias("n")).filter("n <> 0").isEmpty():
        return False
    save(store, folder)
    return True


def map_store(files: DataFrame, value: str = "string") -> DataFrame:
    """(file, key, value) of JSON objects (file, body); a missing or broken one is empty, never an error."""
    m = F.from_json("body", f"map<string,{value}>")
    return files.select("file", F.explode(m).alias("key", "value"))


def migrate_keys(store: DataFrame, folders: Sequence[str], legacy_wins: bool = False) -> DataFrame:
    """Canonical keys; where several meet, one that was canonical already wins, else the smallest old key."""
    key = P.strip_known_folder(P.canonical_path(F.col("key")), folders)
    rows = store.withColumn("new_key", key).withColumn("legacy", F.col("key") != key)
    rank = Window.partitionBy("new_key").orderBy(F.col("legacy").desc() if legacy_wins else F.col("legacy"), "key")
    return rows.withColumn("rn", F.row_number().over(rank)).filter("rn = 1").select(F.col("new_key").alias("key"), "value")


def scope_suspect(store: DataFrame, folders: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """suspect: the number of keys with a folder where none is known, of a whole store or of each group `by`; null if there
    are none or folders are known."""
    n = F.nullif(F.count_if(F.contains("key", F.lit("/"))), F.lit(0).cast("long"))
    return store.groupBy(*by).agg((n if not folders else F.lit(None).cast("long")).alias("suspect"))


def lineage(writes: DataFrame) -> DataFrame:
    """The entry of each path after its writes (line_no, path, seq, prov).

    Every write replaces the one before, a lower sequence too; but an observation of the sequence that was just adopted
    leaves the adoption. So the last write counts, and it reads as adopted if an unbroken run of observations of its
    sequence leads back to an adoption of that sequence.
    """
    order = Window.partitionBy("path").orderBy("line_no")
    # a run: rows of one sequence on end; inside it only the adoptions matter
    t = writes.withColumn("new", F.coalesce((F.lag("seq").over(order) != F.col("seq")).cast("int"), F.lit(1)))
    t = t.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy("path", "run").agg(F.max(F.col("prov") == "adopted").alias("adopted"), F.first("seq").alias("seq"))
    last = Window.partitionBy("path").orderBy(F.desc("run"))
    runs = runs.withColumn("rn", F.row_number().over(last)).filter("rn = 1")
    return runs.select("path", "seq", F.when(F.col("adopted"), "adopted").otherwise("observed").alias("prov"))


def diagnose(responses: DataFrame, schema: str) -> DataFrame:
    """Decoded bodies; where decoding fails the size, and a sample of 256 bytes only of what is no JSON at all."""
    bad = F.col("body").isNotNull() & F.from_json("body", schema).isNull() | F.from_json("body", schema)["path"].isNull()
    json = F.call_function("try_parse_json", F.col("body")).isNotNull()
    sample = F.when(bad & ~json, P.head_bytes(F.col("body"), 256))
    return responses.select("*", F.from_json("body", schema)["path"].alias("path"), bad.alias("failed"), F.when(bad, F.octet_length("body")).alias("size"), sample.alias("sample"))
