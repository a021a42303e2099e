"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash, the head of the MD5 of its id and text. A source whose target is f whole passes and a part takes each
document f times, and once more those whose hash lies under the source's threshold. The threshold is found without a
sort: tokens are summed by source and hash bucket, the bucket where the running sum crosses the budget is refined by
the next hash bits, and so on until it holds one hash (LEVELS rounds at most). Rows that share that hash are copies of one row and
interchangeable: as many of them are taken as come nearest to what is owed, dealt by counts of each partition.

Sources are ordered by code point with null last; weights repeat over that order. Ranges of the order are numbered side
by side, and the budget is dealt by sums over all sources, so no task reads the whole table of sources however many
there are. Joins carry no broadcast hint: Spark
broadcasts the target table where its size is below the session's threshold, else it shuffles. Rows with null ids or texts take part with size 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text_sql import fresh, n_words
from tidemark.plans.staging import stage

HASH_BITS, LEVELS, BITS = 60, 5, 12
CAP = 3


def _numbered(by_source: DataFrame) -> DataFrame:
    """The rows with `rank` from 0 in the order of sources: each range of the order is numbered by itself, and the rows of
    earlier ranges, one count a range, are added."""
    order = F.col("source").asc_nulls_last()
    dealt = by_source.repartitionByRange(order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id())
    dealt = stage(dealt, "mix-sources").withColumn("range", F.shiftright("id", 33))
    parts = dealt.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    ahead = parts.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))
    inside = F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(ahead, "range").withColumn("rank", F.col("ahead") + inside).drop("id", "range", "ahead")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = CAP) -> DataFrame:
    """source, source_size, target: the budget dealt by weight, none above `cap` times its source's size.

    Water filling by sums: the level is (budget - limits of the sources held at them) / (weights of the others); sources
    whose limit the level passes are held, which raises the level, until no more are.
    """
    t = _numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    t = stage(t.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).cast("double").alias("limit")), "mix-weights")
    t = t.withColumn("at", F.col("limit") / F.col("weight"))
    level, before = float("-inf"), -1
    while True:
        held = F.col("at") < F.lit(level)
        sums = t.agg(
            F.count_if(held), F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(held, F.col("limit"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0.0))
        ).first()
        if sums[0] == before or not sums[3]:
            break
        before, level = sums[0], (sums[1] * share - sums[2]) / sums[3]
    filled = F.col("limit") if not sums[3] else F.when(F.col("at") < F.lit(level), F.col("limit")).otherwise(F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", F.least(filled, F.col("limit")).alias("target"))


def _bucket(level: int) -> Column:
    return F.shiftright(F.col("hash"), HASH_BITS - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def thresholds(sized: DataFrame, targets: DataFrame, source_cap: int = CAP) -> tuple[DataFrame, int]:
    """(source, source_size, target, passes, threshold, at_edge, quota) and the hash bits that thresholds have: every document is taken `passes`
    times, and once more if the head of its hash is below the threshold; of the `at_edge` rows (copies of one) whose head is the threshold, `quota` are.

    One histogram a level; after the first, only rows of each source's boundary bucket are counted. It ends where each
    boundary bucket holds one hash, or no hash bits are left: refining further would change nothing.
    """
    size = F.col("source_size")
    passes = F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(source_cap).cast("long"))).otherwise(F.lit(0).cast("long"))
    edge = targets.select("source", "source_size", "target", passes.alias("passes"))
    edge = edge.withColumn("rest", F.col("target") - F.col("passes") * size).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(LEVELS):
        rows = sized
        if level:
            known = edge.select(F.col("source").alias("s"), F.col("prefix").alias("p"))
            at = F.shiftright(F.col("hash"), HASH_BITS - BITS * level) == F.col("p")
            rows = sized.join(known, F.col("source").eqNullSafe(F.col("s")) & at, "left_semi")
        histogram = rows.groupBy("source", _bucket(level).alias("bucket")).agg(F.sum("size").alias("tokens"), F.count("*").alias("rows"), (F.min("hash") < F.max("hash")).alias("mixed"))
        run = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        hs = histogram.select(F.col("source").alias("hs"), F.struct("bucket", "tokens", run.alias("upto"), "rows", "mixed").alias("h"))
        crossed = edge.join(hs, F.col("source").eqNullSafe(F.col("hs")) & (F.col("h.upto") > F.col("rest")), "left")
        first = crossed.groupBy("source", "source_size", "target", "passes", "rest", "prefix").agg(F.min("h").alias("b"))
        # no bucket crosses: all of them fit, the boundary lies past the last
        bucket = F.coalesce(F.col("b.bucket"), F.lit((1 << BITS) - 1).cast("long"))
        spent = F.coalesce(F.col("b.upto") - F.col("b.tokens"), F.lit(0).cast("long"))
        edge = stage(
            first.select(
                "source", "source_size", "target", "passes", (F.col("rest") - spent).alias("rest"), (F.shiftleft(F.col("prefix"), BITS) + bucket).alias("prefix"),
                (F.col("b.bucket").isNull()).alias("all"), F.col("b.tokens").alias("tokens"), F.col("b.rows").alias("rows"), F.coalesce(F.col("b.mixed"), F.lit(False)).alias("mixed"),
            ),
            "mix-edge",
        )
        if edge.filter("mixed AND rest > 0").isEmpty():
            break
    # the boundary bucket holds one hash, so rows of one size: the number of them that comes nearest to what is owed
    owed = F.floor(F.col("rest") / (F.col("tokens") / F.col("rows")) + 0.5).cast("long")
    quota = F.when(F.col("all") | (F.col("rest") <= 0), F.lit(0).cast("long")).otherwise(F.least(owed, F.col("rows")))
    threshold = F.col("prefix") + F.when(F.col("all") & (F.col("rest") > 0), F.lit(1)).otherwise(F.lit(0))
    at_edge = F.coalesce("rows", F.lit(0).cast("long"))
    return edge.select("source", "source_size", "target", "passes", threshold.alias("threshold"), at_edge.alias("at_edge"), quota.alias("quota")), BITS * (level + 1)


def _with_copies(df: DataFrame, hashed: Column, edges: DataFrame, bits: int, cap: int, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rows of `df` and how often each is taken, as the column `name`; `keep` names columns of `edges` to come with them."""
    of = {c: fresh(df, f"mix_{c}") for c in ("source", "passes", "threshold", "at_edge", "quota", "part", "row", "ahead")}
    edges = stage(edges, "mix-thresholds")
    e = edges.select(*[F.col(c).alias(of[c]) for c in ("source", "passes", "threshold", "at_edge", "quota")], *keep)
    joined = df.join(e, df["source"].eqNullSafe(F.col(of["source"])))
    head, quota = F.shiftright(hashed, HASH_BITS - bits), F.col(of["quota"])
    split = (head == F.col(of["threshold"])) & (quota > 0) & (quota < F.col(of["at_edge"]))
    copies = lambda extra: F.least(F.col(of["passes"]) + extra.cast("long"), F.lit(cap).cast("long")).cast("int").alias(name)
    whole = (head < F.col(of["threshold"])) | (head == F.col(of["threshold"])) & (quota > 0)
    if edges.filter("quota > 0 AND quota < at_edge").isEmpty():
        return joined.select(*df.columns, *keep, copies(whole))
    rest = joined.filter(~split).select(*df.columns, *keep, copies(whole))
    # copies of one row are numbered side by side, each partition after what those ahead of it hold
    rows = stage(joined.filter(split).withColumn(of["row"], F.monotonically_increasing_id()), "mix-copies").withColumn(of["part"], F.shiftright(of["row"], 33))
    held = rows.groupBy(of["source"], of["part"]).agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy(of["source"]).orderBy(of["part"])) - F.col("n")
    ahead = held.select(F.col(of["source"]).alias("s"), F.col(of["part"]).alias("p"), ahead.alias(of["ahead"]))
    number = F.row_number().over(Window.partitionBy(of["source"], of["part"]).orderBy(of["row"]))
    dealt = rows.withColumn(of["row"], number).join(ahead, F.col(of["source"]).eqNullSafe(F.col("s")) & (F.col(of["part"]) == F.col("p")))
    return rest.union(dealt.select(*df.columns, *keep, copies(F.col(of["row"]) + F.col(of["ahead"]) <= quota)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = CAP, seed: int = 17) -> DataFrame:
    """doc_id, source, hash, size, source_size, target, taken, copies for every row of `docs` (doc_id, text, source)."""
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(seed).alias("hash")), "mix-sized")
    edges, bits = thresholds(sized, stage(source_targets(sized, weights, share, cap), "mix-targets"), cap)
    rows = _with_copies(sized, F.col("hash"), edges, bits, cap, "copies", ("source_size", "target"))
    return rows.select("doc_id", "source", "hash", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("copies").cast("long").alias("copies"))


def _hash(seed: int) -> Column:
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), none("doc_id"), F.lit(":"), none("text")).cast("binary"))
    return F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long")


def resample(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = CAP, seed: int = 17) -> DataFrame:
    """The mixed corpus: every row of `docs` as often as the mix takes it, with the columns it came with."""
    sized = stage(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _hash(seed).alias("hash")), "mix-sized")
    edges, bits = thresholds(sized, stage(source_targets(sized, weights, share, cap), "mix-targets"), cap)
    copies, copy = fresh(docs, "mix_copies"), fresh(docs, "mix_copy")
    rows = _with_copies(docs, _hash(seed), edges, bits, cap, copies)
    return rows.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(copies)))).select(*docs.columns)
