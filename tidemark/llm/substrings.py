"""Passages that repeat across documents, by content-defined chunks that are deduplicated by digest.

A window is a run of `min_words` whole words with the white space between them. A gear hash rolls over the bytes of a
text; a window's cut is the word end in it with the least gear hash (equal ones by the words ahead of them), so equal
windows have equal cuts wherever they stand, and an insertion moves no cut but those near it. Neighbouring windows with
one cut form a chunk, about one in 16 words. Chunks whose cut lies in two documents or more are grouped by the digest of
their whole bytes: documents of one group share every window of it. Where a cut has several groups (copies that were
edited nearby), the smallest document of each group writes out its windows one by one, and these are grouped by their own
digests, so every holder of a window is held against all others. No pair of documents is formed.

Every window that two documents share is found, whatever its words, and no other, but for equal 64-bit hashes of unequal
bytes. Repeats within one document do not count. Null, empty and short texts have no passages; rows with a null doc_id
take no part; equal rows share their id and so do not repeat each other. Letter case and white space must agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text_sql import replaced
from tidemark.llm.words import SLICE_BYTES, _bounds, mix, slices, span_hashes, texts_of
from tidemark.plans.staging import stage

MIN_WORDS = 50
#: Bytes that the gear hash looks back on, and its table: a number for each value of a byte.
GEAR_BYTES = 32
_GEAR = np.random.default_rng(41).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by doubling."""
    m, have = h, 1
    while have < width:
        step = min(have, width - have)
        m, have = np.minimum(m[:-step], m[step:]), have + step
    return m


def gear_hashes(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The gear hash of the `width` bytes (a power of two) that end at each place of `at`, rising.

    h = (h << shift) + gear[byte] forgets a byte after `width` steps. Runs of 1, 2, 4 ... bytes are put together from two
    halves, for a slice of the text at a time.
    """
    out, shift, i = np.empty(len(at), np.uint64), 64 // width, 0
    while i < len(at):
        j = max(int(np.searchsorted(at, at[i] + SLICE_BYTES)), i + 1)
        lo = max(int(at[i]) - width + 1, 0)
        h, have = _GEAR[data[lo : int(at[j - 1]) + 1]], 1
        while have < width:
            longer = h.copy()
            longer[have:] += h[:-have] << np.uint64(shift * have)
            h, have = longer, 2 * have
        out[i:j] = h[at[i:j] - lo]
        i = j
    return out


def units(data: np.ndarray, offsets: np.ndarray, min_words: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, digest, first window, last window) of the chunks of a slice of documents, and the starts and ends
    of its words; a window has the number of its first word. A chunk's anchor names its cut: the head of the gear hash
    there, then that of the digest of the run of words ahead of it, which lies within every window of the chunk."""
    starts, ends = _bounds(data, offsets)
    firsts = np.searchsorted(starts, offsets)
    n, run = len(starts), max(min_words * 2 // 5, 1)
    if n < min_words:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64), none, none, starts, ends
    # a run of words has at least 2 * run - 1 bytes, so the gear hash at its end knows nothing of what comes before it
    gear = mix(gear_hashes(data, ends[run - 1 :] - 1, min(GEAR_BYTES, 1 << (2 * run - 1).bit_length() - 1)))
    half = np.uint64(32)
    cuts = gear >> half << half | span_hashes(data, starts[: n - run + 1], ends[run - 1 :]) >> half
    least = _least(cuts, min_words - run + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + min_words <= firsts[doc + 1])
    new = np.ones(len(at) + 1, bool)
    new[1:-1] = (doc[at][1:] != doc[at][:-1]) | (least[at][1:] != least[at][:-1])
    edge = np.flatnonzero(new)
    lo, hi = at[edge[:-1]], at[edge[1:] - 1]
    return doc[lo], least[lo], span_hashes(data, starts[lo], ends[hi + min_words - 1]), lo, hi, starts, ends


def _points(data: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def unit_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(anchor, unit, doc_id, word, start, end, n) of all units: first word, code points, number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = texts_of(batch.column("text"))
            for i, j in slices(data, offsets):
                local, part = offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]]
                doc, anchor, unit, lo, hi, starts, ends = units(part, local, min_words)
                points, first = _points(part), np.searchsorted(starts, local)
                base = points[local[doc]]
                columns = [anchor.view(np.int64), unit.view(np.int64), ids[i + doc], lo - first[doc], points[starts[lo]] - base, points[ends[hi + min_words - 1]] - base, hi - lo + 1]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.int32()] * 4)], ["anchor", "unit", "doc_id", "word", "start", "end", "n"])

    return docs.mapInArrow(run, "anchor long, unit long, doc_id long, word int, start int, end int, n int")


def window_rows(docs: DataFrame, min_words: int) -> DataFrame:
    """(anchor, unit, k, digest, start, end, lo, next) of the windows of the units named in `wanted`, counted from the unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column("wanted")
            data, offsets = texts_of(batch.column("text"))
            for r in range(batch.num_rows):
                names = {w["unit"]: w for w in wanted[r].as_py()}
                part = data[offsets[r] : offsets[r + 1]]
                _, anchor, unit, lo, hi, starts, ends = units(part, np.array([0, len(part)]), min_words)
                unit, picked = unit.view(np.int64), {}
                for x in np.flatnonzero(np.isin(unit, np.fromiter(names, np.int64, len(names)))):
                    picked.setdefault(int(unit[x]), x)
                if not picked:
                    continue
                at = np.array(sorted(picked.values()))
                count = hi[at] - lo[at] + 1
                k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                w, points = np.repeat(lo[at], count) + k, _points(part)
                base = np.repeat(points[starts[lo[at]]], count)
                digest = span_hashes(part, starts[w], ends[w + min_words - 1]).view(np.int64)
                docs_of = [pa.array([names[int(unit[x])][c] for x in at], pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), count))) for c in ("lo", "next")]
                columns = [np.repeat(anchor[at].view(np.int64), count), np.repeat(unit[at], count), k.astype(np.int32), digest, (points[starts[w]] - base).astype(np.int32), (points[ends[w + min_words - 1]] - base).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *docs_of], ["anchor", "unit", "k", "digest", "start", "end", "lo", "next"])

    return docs.mapInArrow(run, "anchor long, unit long, k int, digest long, start int, end int, lo long, next long")


def passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, first, start, end, word, n, partner_id: runs of n neighbouring windows that another document has.

    Positions are code points, end exclusive; `word` is the number of the first word. The smallest document with a window has
    it `first`, with the next smallest as its partner; it is itself the partner of all others.
    """
    docs = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = unit_rows(docs, min_words).groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("unit").alias("c"), F.max("unit").alias("d"))
    shared = shared.filter("a <> b").select("anchor", (F.col("c") != F.col("d")).alias("mixed"))
    held = stage(unit_rows(docs, min_words).join(shared, "anchor"), "units")

    key = ["anchor", "unit"]
    least = held.groupBy(*key).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.first("mixed").alias("mixed"), F.first("n").alias("n"), F.first(F.col("end") - F.col("start")).alias("long"))
    several = least.filter("lo <> hi").select(*key, "lo")
    after = held.join(several, key).filter("doc_id <> lo").groupBy(*key).agg(F.min("doc_id").alias("next"))
    groups = stage(least.drop("hi").join(after, key, "left"), "groups")

    wanted = groups.filter("mixed").groupBy(F.col("lo").alias("id")).agg(F.collect_list(F.struct("unit", "lo", "next")).alias("wanted"))
    windows = stage(window_rows(docs.join(wanted, F.col("doc_id") == F.col("id")).select("text", "wanted"), min_words).dropDuplicates([*key, "k"]), "windows")
    owned = windows.groupBy("digest").agg(F.min("lo").alias("owner"), F.max(F.coalesce("next", "lo")).alias("top")).filter("owner <> top").select("digest", "owner")
    found = windows.join(owned, "digest")
    second = found.groupBy("digest").agg(F.min(F.when(F.col("lo") != F.col("owner"), F.col("lo")).otherwise(F.col("next"))).alias("second"))
    found = found.drop("lo", "next").join(second, "digest")
    run = F.col("k") - F.row_number().over(Window.partitionBy(*key, "owner", "second").orderBy("k"))
    parts = found.withColumn("run", run).groupBy(*key, "owner", "second", "run").agg(F.min("k").alias("k"), F.min("start").alias("from"), F.max("end").alias("to"), F.count(F.lit(1)).cast("int").alias("windows"))
    whole = groups.filter("NOT mixed AND next IS NOT NULL").select(*key, F.col("lo").alias("owner"), F.col("next").alias("second"), F.lit(0).alias("k"), F.lit(0).alias("from"), F.col("long").alias("to"), F.col("n").alias("windows"))
    runs = whole.unionByName(parts.drop("run"))

    first = F.col("doc_id") == F.col("owner")
    place = [(F.col("start") + F.col(c)).cast("long").alias(name) for c, name in (("from", "start"), ("to", "end"))]
    return held.select(*key, "doc_id", "word", "start").join(runs, key).select("doc_id", first.alias("first"), *place, (F.col("word") + F.col("k")).alias("word"), F.col("windows").alias("n"), F.when(first, F.col("second")).otherwise(F.col("owner")).alias("partner_id"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, start, end, n_words, partner_id, first: the passages of each document, those that overlap as one.

    n_words is that of the longest run of words merged whose windows all have one partner, partner_id the smallest partner.
    """
    found = passages(docs, min_words).distinct()
    order = Window.partitionBy("doc_id", "first").orderBy("start", "end", "partner_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start") > reach), F.lit(1)).otherwise(F.lit(0))
    goes_on = (F.lag("partner_id").over(order) == F.col("partner_id")) & (F.lag("word").over(order) + F.lag("n").over(order) == F.col("word"))
    grouped = found.withColumn("new", new).withColumn("turn", F.when(goes_on, F.lit(0)).otherwise(F.lit(1))).withColumn("group", F.sum("new").over(so_far)).withColumn("turn", F.sum("turn").over(so_far))
    grouped = grouped.groupBy("doc_id", "first", "group", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.sum("n") + min_words - 1).alias("n_words"), F.min("partner_id").alias("partner_id"))
    merged = grouped.groupBy("doc_id", "first", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("n_words").alias("n_words"), F.min("partner_id").alias("partner_id"))
    return merged.select("doc_id", "start", "end", "n_words", "partner_id", "first")


def drop_repeats(docs: DataFrame, spans: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` with every passage cut out that an earlier document has; first copies stay."""
    cuts = spans.filter("NOT first").groupBy(F.col("doc_id").alias("cut_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cut_spans"))
    rest = replaced(F.col(text_col), F.col("cut_spans"), lambda s: F.lit(""))
    joined = docs.join(cuts, docs["doc_id"] == F.col("cut_id"), "left")
    return joined.select(*[F.when(F.col("cut_spans").isNull(), docs[c]).otherwise(rest).alias(c) if c == text_col else docs[c] for c in docs.columns])
