"""Server notes written to several stores in one step.

The stores (notes, baseline, lineage, ledger, stashes) lie in BUCKETS buckets of paths. A micro-batch decides for each of its paths, writes
the buckets that it touches of every store in new folders, and then renames one manifest into place, which names the folder of each
store's buckets and the number of the batch. So readers see all stores before a batch or all behind it: a run that fails between two of
them leaves the old manifest and some files that none names; of two writers the later one fails; a batch that a manifest knows changes nothing.
Work is proportional to the buckets touched, not to the stores.

Texts lie beside the buckets and are written once, by the commit that brings them; rows of notes and stashes say where. So a commit rewrites
hashes and numbers only, and a note that becomes a stash is not copied. Texts that no row names any more stay, as do the buckets of older manifests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import paths as P
from tidemark.operators import reconcile as R
from tidemark.plans.staging import release, stage

STORES = {
    "notes": "path STRING, content STRING, sha STRING", "baseline": "path STRING, server_hash STRING", "lineage": "path STRING, seq BIGINT, prov STRING",
    "ledger": "path STRING, attempts BIGINT, last_error STRING", "stashes": "path STRING, stash STRING, content STRING",
}
#: What the buckets hold of the stores with texts: the folder of the text and its number there.
INDEX = STORES | {"notes": "path STRING, sha STRING, at STRING, id BIGINT", "stashes": "path STRING, stash STRING, at STRING, id BIGINT"}
BUCKETS = 64
#: Bits of the map that tells which texts a join may need.
BITS = 1 << 22


def _bucket():
    return F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _near(rows: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """`rows` without most of those whose keys are not among `wanted`, for an exact join that follows: a map of BITS bits goes to the rows, so
    that few texts go to the join. However many are wanted, none of them is left out."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(BITS))
    word, place = F.shiftright(bit, 6).alias("word"), (bit % 64).cast("int")
    held = wanted.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place)).alias("bits"))
    return rows.withColumn("word", word).join(F.broadcast(held), "word").filter(F.getbit("bits", place) == 1).drop("word", "bits")


class Stores:
    """The stores of one folder as their last manifest has them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))] if self._fs.exists(self._path(folder)) else []
        self.number = max((int(n[9:-5]) for n in found if n.startswith("manifest-")), default=0)
        self.batch, self.held, self.texts = -1, {name: {} for name in STORES}, []
        if self.number:
            text = spark.read.option("wholetext", True).text(f"{folder}/manifest-{self.number}.json").first()[0]
            state = json.loads(text)
            self.batch, self.held = state["batch"], {name: {int(b): v for b, v in of.items()} for name, of in state["held"].items()}
            self.texts = state["texts"]

    def index(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The rows of a store as INDEX has them, of the buckets `only` if given; no text is read."""
        paths = [f"{self.folder}/{name}/{v}/bucket={b}" for b, v in self.held[name].items() if only is None or b in only]
        return self.spark.read.schema(INDEX[name]).parquet(*paths) if paths else self.spark.createDataFrame([], INDEX[name])

    def read(self, name: str, only: set[int] | None = None) -> DataFrame:
        """The rows of a store, of the buckets `only` if given, with their texts."""
        rows = self.index(name, only)
        if INDEX[name] == STORES[name]:
            return rows
        if not self.texts:
            return self.spark.createDataFrame([], STORES[name])
        texts = self.spark.read.schema("id BIGINT, content STRING, at STRING").option("basePath", f"{self.folder}/texts").parquet(*[f"{self.folder}/texts/at={v}" for v in self.texts])
        return rows.join(_near(texts, ["at", "id"], rows), ["at", "id"]).select(*[c.split()[0] for c in STORES[name].split(", ")])

    def keep(self, rows: DataFrame) -> tuple[str, DataFrame]:
        """Write the texts of `rows`, where they lie, and give the folder's name and the rows with at and id for content. A commit names it."""
        at = f"v{self.number + 1}-{uuid.uuid4().hex}"
        numbered = rows.withColumn("id", F.monotonically_increasing_id())
        numbered.write.option("compression", "zstd").parquet(f"{self.folder}/texts/at={at}")
        return at, self.spark.read.schema(numbered.schema).parquet(f"{self.folder}/texts/at={at}").drop("content").withColumn("at", F.lit(at))

    def commit(self, rows: dict[str, DataFrame], touched: set[int], batch: int, texts: Sequence[str] = ()) -> None:
        """`rows` has all rows that the touched buckets of each store are to have, with their texts or where keep() put them (`texts`: the folders).
        Nothing is seen of them before the last step."""
        number, held = self.number + 1, {name: {b: v for b, v in of.items() if name not in rows or b not in touched} for name, of in self.held.items()}
        texts = [*self.texts, *texts]
        for name, df in rows.items():
            if "content" in df.columns:
                at, df = self.keep(df)
                texts.append(at)
            version = f"v{number}-{uuid.uuid4().hex}"
            to = f"{self.folder}/{name}/{version}"
            df.select(*[c.split()[0] for c in INDEX[name].split(", ")], _bucket()).repartition("bucket").write.partitionBy("bucket").parquet(to)
            written = [s.getPath().getName() for s in self._fs.listStatus(self._path(to))]
            held[name] |= {int(n.partition("=")[2]): version for n in written if n.startswith("bucket=")}
        draft, last = self._path(f"{self.folder}/_draft-{uuid.uuid4().hex}"), self._path(f"{self.folder}/manifest-{number}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "held": held, "texts": texts}).encode()))
        out.close()
        if not self._fs.rename(draft, last):
            raise RuntimeError(f"another writer has committed version {number} of {self.folder}")
        self.number, self.batch, self.held, self.texts = number, batch, held, texts


def decisions(fresh: DataFrame, notes: DataFrame, baseline: DataFrame) -> DataFrame:
    """path, server_hash, seq of `fresh` and what to do: integrity_failed (not `sound`), create, or the rule of the comparison. Hashes only, no texts."""
    rows = fresh.select("path", "server_hash", "seq", "sound").join(notes.select("path", "sha"), "path", "left").join(baseline.select("path", F.col("server_hash").alias("base")), "path", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    rule = R.decide(same("sha", "server_hash"), F.col("base").isNotNull(), same("base", "server_hash"), same("sha", "base"))
    decision = F.when(~F.col("sound"), "integrity_failed").when(F.col("sha").isNull(), "create").otherwise(rule)
    return rows.select("path", "server_hash", "seq", decision.alias("decision"))


def apply_batch(stores: Stores, batch: DataFrame, number: int, device: str) -> bool:
    """Decide and write one batch of (path, content, server_hash, seq); False if it was written before. Of several rows of a path the last
    sequence counts (ties: the largest hash).

    Creates, clean pulls and conflicts write the server's note and adopt its sequence; of a conflict the local bytes go to a stash. Equal
    notes record the baseline. Local edits stay as they are. Bytes that do not match their hash write nothing and add to the ledger.
    The batch is read twice: for its hashes, then for the texts that are written; only those move.
    """
    if number <= stores.batch:
        return False
    sound = F.coalesce(F.sha2("content", 256) == F.lower("server_hash"), F.lit(False))
    latest = F.struct("seq", "server_hash", "sound")
    safe = batch.filter("path IS NOT NULL").filter(P.is_safe(F.col("path"))).withColumn("sound", sound)
    fresh = stage(safe.groupBy("path").agg(F.max(latest).alias("m")).select("path", F.lower("m.server_hash").alias("server_hash"), "m.seq", "m.sound"), "fresh")
    touched = {r["bucket"] for r in fresh.select(_bucket()).distinct().collect()}
    old = {name: stores.index(name, touched) for name in STORES}
    rows = stage(decisions(fresh, old["notes"], old["baseline"]), "decided")
    written = F.col("decision").isin("create", "R3_pull_clean", "R4_conflict", "R5_conflict")
    synced = rows.filter(written | (F.col("decision") == "R1_noop"))
    less = lambda name, paths: old[name].join(paths.select("path"), "path", "left_anti")
    # only now the texts, of what is written: the rows that were decided for, as they have the same order
    wanted = rows.filter(written).select("path")
    new = _near(batch, ["path"], wanted).join(wanted, "path", "left_semi").withColumn("sound", sound).groupBy("path").agg(F.max_by(F.struct("content", "server_hash"), latest).alias("m"))
    at, new = stores.keep(new.select("path", "m.content", F.lower("m.server_hash").alias("sha")))
    failed = rows.filter("decision = 'integrity_failed'").select("path").join(old["ledger"].select("path", "attempts"), "path", "left")
    attempts = (F.coalesce("attempts", F.lit(0)) + 1).cast("long").alias("attempts")
    conflict = rows.filter(F.col("decision").isin("R4_conflict", "R5_conflict")).select("path", P.stash_path(F.col("path"), F.lit(device), F.col("seq").cast("string")).alias("stash"))
    stashed = old["notes"].join(conflict, "path").select("path", "stash", "at", "id")
    out = {
        "notes": less("notes", rows.filter(written)).unionByName(new),
        "baseline": less("baseline", synced).unionByName(synced.select("path", "server_hash")),
        "lineage": less("lineage", synced).unionByName(synced.select("path", "seq", F.when(written, "adopted").otherwise("observed").alias("prov"))),
        "ledger": less("ledger", rows).unionByName(failed.select("path", attempts, F.lit("integrity_failed").alias("last_error"))),
        "stashes": old["stashes"].join(conflict, ["path", "stash"], "left_anti").unionByName(stashed),
    }
    stores.commit(out, touched, number, [at])
    return True


def materialize(stream: DataFrame, spark: SparkSession, folder: str, checkpoint: str, device: str) -> Stores:
    """Run a stream of server notes to its end and return the stores."""

    def write(batch: DataFrame, number: int) -> None:
        apply_batch(Stores(batch.sparkSession, folder), batch, number, device)
        release(batch.sparkSession)

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return Stores(spark, folder)
