"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)

The pair term is computed in linear time as half of sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2).
Features: distinct lower-cased words hashed to 2**WORD_BITS buckets, each statistic of the text in one of BINS
quantile bins, and the bins of the n_chars metadata. Labels, lang, source and doc_id are no features.

The model is fitted on at most `max_rows` labelled rows, those with the smallest hash of their id, whatever the size of
the corpus, and of an id with several rows on the one with the smallest hash; scoring reads every document whole. Null and empty texts have no word features and get a score from their
statistics. Labels that contradict each other for one id are left out. Without labels of both kinds every score is
the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import slices, texts_of, word_hashes

WORD_BITS, RANK, BINS = 14, 8, 12
MAX_ROWS = 6000
_FLAGS = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&|<>", "bang": b"!?", "stop": b".,;:", "line": b"\n", "quote": b"\"'`()[]{}", "wide": range(0xC0, 0x100),
}
_TABLES = {k: np.isin(np.arange(256), list(v)) for k, v in _FLAGS.items()}
STATS = ("log_bytes", "log_words", "mean_word", "distinct", "adjacent", "words_per_line", "log_n_chars", *_FLAGS)


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistics by document, owner and bucket of each distinct word bucket) for one slice of documents."""
    hashes, starts, ends, firsts = word_hashes(data, offsets)
    n = len(offsets) - 1
    size, count = np.diff(offsets).astype(float), np.diff(firsts).astype(float)
    owner = np.repeat(np.arange(n), np.diff(firsts))
    out = np.zeros((n, len(STATS)))
    per = lambda a, b: a / np.maximum(b, 1)
    out[:, 0], out[:, 1] = np.log1p(size), np.log1p(count)
    out[:, 2] = per(np.bincount(owner, ends - starts, n), count)
    order = np.lexsort((hashes, owner))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    out[:, 3] = per(np.bincount(owner[order][fresh], minlength=n), count)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, 4] = per(np.bincount(owner[same], minlength=n), count)
    for j, name in enumerate(_FLAGS):
        run = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_TABLES[name][data], out=run[1:])
        out[:, 7 + j] = per((run[offsets[1:]] - run[offsets[:-1]]).astype(float), size)
    out[:, 5] = per(count, out[:, STATS.index("line")] * size + 1)
    out[:, 6] = np.log1p(np.maximum(n_chars, 0))
    key = np.unique((owner.astype(np.int64) << WORD_BITS) | (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
    return out, key >> WORD_BITS, key & ((1 << WORD_BITS) - 1)


def _batches(batch: pa.RecordBatch, text: str, n_chars: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    data, offsets = texts_of(batch.column(text))
    chars = np.nan_to_num(batch.column(n_chars).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False))
    for i, j in slices(data, offsets):
        yield i, j, *features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], chars[i:j])


@dataclass
class Model:
    """edges: bin edges by statistic; bias, w, v: the machine's weights. v is None where one score serves all."""

    edges: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray | None

    def bins(self, stats: np.ndarray) -> np.ndarray:
        at = np.stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, stats.T, strict=True)], 1)
        return (1 << WORD_BITS) + at + np.arange(len(STATS)) * BINS

    def score(self, stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        n = len(stats)
        if self.v is None:
            return np.full(n, self.bias)
        z, _ = _forward(*_design(self.bins(stats), owner, bucket, n), n, self.bias, self.w, self.v)
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _design(bins: np.ndarray, owner: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of every non-zero: words share a length of 1, so do the statistics."""
    scale = 1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))
    row = np.concatenate([owner, np.repeat(np.arange(n), bins.shape[1])])
    value = np.concatenate([scale[owner], np.full(bins.size, 1 / np.sqrt(bins.shape[1]))])
    return row, np.concatenate([bucket, bins.ravel()]), value


def _forward(row, feature, value, n, bias, w, v):
    z = bias + np.bincount(row, w[feature] * value, n)
    sums = np.empty((n, v.shape[1]))
    for f in range(v.shape[1]):
        t = v[feature, f] * value
        sums[:, f] = np.bincount(row, t, n)
        z += 0.5 * (sums[:, f] ** 2 - np.bincount(row, t * t, n))
    return z, sums


def train(stats: np.ndarray, owner: np.ndarray, bucket: np.ndarray, y: np.ndarray, epochs: int = 10, least_steps: int = 150, batch: int = 400, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Adam on the log loss of a bounded sample, in batches of rows dealt by a fixed seed; a small sample is gone over more often."""
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if len(y) else np.zeros((len(STATS), BINS - 1))
    if len(y) == 0 or y.min() == y.max():
        return Model(edges, float(y.mean()) if len(y) else 0.5, np.zeros(0), None)
    size, rng = (1 << WORD_BITS) + len(STATS) * BINS, np.random.default_rng(7)
    model = Model(edges, 0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    bins, buckets = model.bins(stats), np.split(bucket, np.searchsorted(owner, np.arange(1, len(y))))
    theta = [np.array([np.log(y.mean() / (1 - y.mean()))]), model.w, model.v]
    first, second, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    for _ in range(max(epochs, -(-least_steps * batch // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            docs, step = order[at : at + batch], step + 1
            n, held = len(docs), [buckets[d] for d in docs]
            row, feature, value = _design(bins[docs], np.repeat(np.arange(n), [len(h) for h in held]), np.concatenate(held), n)
            z, sums = _forward(row, feature, value, n, theta[0][0], theta[1], theta[2])
            err = ((1 / (1 + np.exp(-np.clip(z, -35, 35)))) - y[docs]) / n
            pull = err[row] * value
            gw = np.bincount(feature, pull, size) + decay * theta[1]
            gv = np.empty_like(theta[2])
            for f in range(RANK):
                gv[:, f] = np.bincount(feature, pull * (sums[row, f] - theta[2][feature, f] * value), size) + decay * theta[2][:, f]
            for k, g in enumerate((np.array([err.sum()]), gw, gv)):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                theta[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Model(edges, float(theta[0][0]), theta[1], theta[2])


def learnable(doc_id) -> F.Column:
    """Rows that labels may be learned from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Train on the labelled documents. At most `max_rows` rows of hashed features reach the driver."""
    rated = labels.filter(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("lo"), F.max("quality").alias("hi"))
    picked = rated.filter("lo = hi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id", F.col("lo").cast("double").alias("y"))
    # max_rows ids and labels: a few hundred kilobytes at most
    rows = docs.select("doc_id", "text", "n_chars", F.xxhash64("text", "n_chars").alias("key")).join(F.broadcast(picked), "doc_id")
    # an id may come with any number of rows: one of them is left before anything is sent to the driver
    least = rows.groupBy("doc_id").agg(F.min("key").alias("key"))
    rows = rows.join(F.broadcast(least), ["doc_id", "key"]).dropDuplicates(["doc_id"]).select("text", "n_chars", "y")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for i, j, stats, owner, bucket in _batches(batch, "text", "n_chars"):
                cut = np.searchsorted(owner, np.arange(1, j - i))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(y[i:j]), pa.array(list(stats)), pa.array(np.split(bucket.astype(np.int32), cut), pa.list_(pa.int32()))], ["y", "stats", "buckets"]
                )

    got = rows.mapInArrow(extract, "y double, stats array<double>, buckets array<int>").toArrow()
    # in an order that reruns share
    order = sorted(range(len(got)), key=lambda i: (got["stats"][i].as_py(), got["y"][i].as_py()))
    got = got.take(pa.array(order, pa.int64()))
    stats = np.array(got["stats"].to_pylist()).reshape(-1, len(STATS))
    buckets = got["buckets"].combine_chunks()
    sizes = np.array([len(b) for b in buckets], int)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    flat = np.concatenate([b.values.to_numpy() for b in buckets]).astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    return train(stats, owner, flat, got["y"].to_numpy())


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of `docs` with the score as one more column, called `name`."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for i, j, stats, owner, bucket in _batches(batch, "text", "n_chars"):
                out[i:j] = model.score(stats, owner, bucket)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text, n_chars)."""
    docs = docs.select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars"))
    scored = with_score(docs, fit(docs, labels, max_rows)).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
