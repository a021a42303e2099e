"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

A document's set is its distinct k-word shingles after lower-casing A-Z (with fewer words the whole sequence as one).
Documents with equal sets form a class at once; only a class's representative goes further.

1. Signature: POSITIONS minima of multiplied shingle hashes, cut to 8 bits each, the first INDEXED to 16 bits for the index.
   Sets of similarity s differ in each position with probability just under 1 - s; distance thresholds are the number
   of differences that such sets pass with chance LOSS at most.
2. Index: the first INDEXED positions are split into so many groups that two signatures within `max_errors` differences
   there agree in some group up to one position (pigeonhole: with c groups, up to 2 * c - 1 differences). Each group is
   indexed once for each position left out, so all pairs within the distance share a key. A similarity so low that
   groups would have fewer than three positions is an error.
3. Links. First round: in each key the pairs whose whole signatures look linked are gathered to a spanning forest, so
   a key of n rows gives about n pairs (rows of a large key are held against those of their own block and of one
   pivot block); these are confirmed on full sets, and components are formed. Second
   round: in keys whose rows are still of several components, those that have a pair of different components within
   the distance threshold of the whole signature are linked to clusters, again by forests. A cluster's documents are
   then held against each other on full sets wherever two components come within the threshold, in pairs of blocks of
   about TEXT_BLOCK texts or BLOCK_SHINGLES shingles, and each gives a forest of its links. So no link between components is lost,
   and what is written grows with the documents of a group, not with its pairs. Large keys are cut into blocks too.
4. Components of the confirmed links; the smallest doc_id stands for each.

Null, empty and blank texts have an empty set and link with nothing. Rows that repeat are rows of one class, of
which one row's text is moved and compared. A row with a null doc_id links with nothing and is its own component (null), kept. Very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.text_sql import fresh
from tidemark.llm.words import mix, shingles, slices, texts_of, word_hashes
from tidemark.plans.staging import stage

POSITIONS, INDEXED = 256, 64
BLOCK, TEXT_BLOCK, BLOCK_SHINGLES, GROUP = 2048, 256, 1 << 21, 64
LOSS = 1e-5
_MULTIPLIERS = (np.random.default_rng(20).integers(0, 1 << 32, POSITIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)


def max_errors(similarity: float, positions: int = INDEXED) -> int:
    """The least number of differing positions that two sets of that similarity exceed with chance LOSS at most."""
    p, left = 1 - similarity, 1.0
    for m in range(positions + 1):
        left -= comb(positions, m) * p**m * (1 - p) ** (positions - m)
        if left <= LOSS:
            return m
    return positions


def position_groups(similarity: float) -> list[np.ndarray]:
    """The indexed positions in groups, of which two signatures within max_errors() agree in one up to one position."""
    count = max_errors(similarity) // 2 + 1
    if INDEXED // count < 3:
        raise ValueError(f"an index of {INDEXED} positions cannot serve a similarity of {similarity}")
    return np.array_split(np.arange(INDEXED), count)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text of a column."""
    data, offsets = texts_of(column)
    for i, j in slices(data, offsets):
        hashes, _, _, firsts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for d in range(j - i):
            yield shingles(hashes[firsts[d] : firsts[d + 1]], k)


def signature(s: np.ndarray) -> bytes:
    """One byte a position, then a second one for each indexed position: bits of the least product, by multipliers fixed
    for all documents."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        np.minimum(least, (x[i : i + 1024, None] * _MULTIPLIERS).min(0), out=least)
    bits = mix(least.astype(np.uint64))
    return (bits >> np.uint64(56)).astype(np.uint8).tobytes() + (bits[:INDEXED] >> np.uint64(48)).astype(np.uint8).tobytes()


def _unpack(signatures: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), np.uint8).reshape(len(signatures), POSITIONS + INDEXED)


def digests(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_id (16 bytes, equal for equal sets; null for the empty set), signature and the text itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, signatures = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                empty = len(s) == 0
                sums = None if empty else np.array([s.sum(dtype=np.uint64), mix(s ^ np.uint64(0x5BD1E9955BD1E995)).sum(dtype=np.uint64)]).tobytes()
                ids.append(sums)
                signatures.append(None if empty else signature(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary()), batch.column("text")], ["doc_id", "n_shingles", "set_id", "signature", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, set_id binary, signature binary, text string")


def index_keys(reps: DataFrame, groups: list[np.ndarray]) -> DataFrame:
    """(key, rep) for every group of positions and every position of it left out: INDEXED rows a signature."""
    weights = mix(np.arange(1, INDEXED + 1, dtype=np.uint64)) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n = part.num_rows
                both = _unpack(part.column("signature").to_pylist()).astype(np.uint64)
                sig = both[:, :INDEXED] << np.uint64(24) | both[:, POSITIONS:] << np.uint64(16)
                terms = mix(sig + np.uint64(1) + (np.arange(INDEXED, dtype=np.uint64) << np.uint64(8))) * weights
                keys = np.empty((n, INDEXED), np.uint64)
                for g in groups:
                    whole = terms[:, g].sum(1, dtype=np.uint64)
                    for p in g:
                        # the lowest bit marks one key of each group
                        keys[:, p] = mix((whole - terms[:, p]) ^ weights[p]) & ~np.uint64(1) | np.uint64(p == g[0])
                rep = part.column("rep").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(rep, INDEXED))], ["key", "rep"])

    return reps.select("rep", "signature").mapInArrow(run, "key long, rep long")


def confirm(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of representatives (rep, text_id) whose full sets have at least the similarity, from `texts` (text_id, text).

    Pairs are dealt by (a, salt) so that the text of a is sent once for about GROUP partners, and a document with very
    many partners is spread over tasks; a task streams its sorted rows and holds one set of a at a time.
    """
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(counted, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / GROUP)).cast("int").alias("salt"))
    salted = stage(salted, "dup-pairs")
    # the one pass that moves texts: only those of documents in some pair go on
    wanted = salted.select(F.col("a").alias("rep")).union(salted.select("b")).distinct()
    wanted = reps.select("rep", "text_id").join(wanted, "rep", "left_semi")
    docs = stage(texts.join(wanted.hint("merge"), "text_id").select("rep", "text"), "dup-texts")
    heads = salted.select("a", "salt").distinct().join(docs, F.col("a") == docs["rep"]).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    tails = salted.join(docs, F.col("b") == docs["rep"]).select("a", "salt", "b", "text")
    dealt = heads.union(tails).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    hundredths = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            out: tuple[list, list] = ([], [])
            for i, s in enumerate(shingle_sets(batch.column("text"), k)):
                if b[i] is None:
                    head = s
                    continue
                if _linked(head, s, hundredths):
                    out[0].append(a[i])
                    out[1].append(b[i])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], ["a", "b"])

    return stage(dealt.mapInArrow(run, "a long, b long"), "dup-links")


class _Forest:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)
        return x != y


def _forest_of_key(rep: np.ndarray, label: np.ndarray, own: np.ndarray, sig: np.ndarray, most: int) -> tuple[list, list, np.ndarray]:
    """(a, b) of pairs of rows that join the labels of near rows to trees, and all rows near one of another label.

    Rows of two blocks are compared across the blocks only. With a label for each row, a row is compared with those
    that are not in its tree yet.
    """
    order = np.argsort(rep, kind="stable")
    rep, label, own, sig = rep[order], label[order], own[order], sig[order]
    split = own.min() != own.max()
    names, tree, counts = np.unique(label, return_inverse=True, return_counts=True)
    fixed, index, met = tree.copy(), np.arange(len(rep)), np.zeros(len(rep), bool)
    single = counts.max() == 1
    a, b = [], []
    # rows of the commonest label are compared from the other side
    for x in index if single else np.flatnonzero(fixed != counts.argmax()):
        apart = (index > x) & (tree != tree[x]) if single else (fixed != fixed[x]) & ((fixed == counts.argmax()) | (index > x))
        if split:
            apart &= own != own[x]
        rest = np.flatnonzero(apart)
        rest = rest[(sig[rest] != sig[x]).sum(1) <= most] if len(rest) else rest
        if not len(rest):
            continue
        met[x] = met[rest] = True
        for t, y in zip(*np.unique(tree[rest], return_index=True)):
            if t != tree[x]:
                a.append(int(rep[x]))
                b.append(int(rep[rest[y]]))
                tree[tree == t] = tree[x]
    return a, b, rep[met]


def _blocked(rows: DataFrame, key: str, pivot: bool = False) -> DataFrame:
    """Deal rows (with the number of blocks of their key) to pairs of blocks (i, j) of their key; a small key has one pair.

    With `pivot` only to pairs of a block with itself and with block 0: rows sent then grow with the rows of a key.
    """
    blocks, others = F.col("blocks"), F.sequence(F.lit(0), F.col("blocks") - 1)
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    rows = rows.withColumn("other", F.explode(F.when(F.col("own") > 0, F.array(F.lit(0), "own")).otherwise(others) if pivot else others))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "blocks")
    return rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _groups(batches: Iterator[pa.RecordBatch], key: str, columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of one (key, i, j) at a time, from sorted rows."""
    at, group = None, []
    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in (key, "i", "j", *columns)]
        for k, i, j, *row in zip(*cols, strict=True):
            if (k, i, j) != at:
                if len(group) > 1:
                    yield group
                at, group = (k, i, j), []
            group.append(tuple(row))
    if len(group) > 1:
        yield group


def _arrays(group: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rep, label, own = (np.array([g[c] for g in group]) for c in range(3))
    return rep, label, own, _unpack([g[3] for g in group])[:, :POSITIONS]


def near_pairs(keys: DataFrame, labels: DataFrame | None, reps: DataFrame, most: int) -> DataFrame:
    """(a, b): forests over the rows of each key whose signatures differ in at most `most`, between labels (the rows
    themselves, if none are given); with labels also (a, null) for every row that has a near row of another label."""
    rows = keys.withColumn("label", F.col("rep"))
    if labels is not None:
        rows = keys.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        mixed = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
        rows = rows.join(mixed, "key", "left_semi")
    rows = rows.join(reps.select("rep", "signature"), "rep").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "rep", "label", "signature")
    labels = None if labels is None else True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for group in _groups(batches, "key", ("rep", "label", "own", "signature")):
            a, b, met = _forest_of_key(*_arrays(group), most)
            pairs = {(min(x, y), max(x, y)) for x, y in zip(a, b)}
            if labels is not None:
                pairs |= {(x, None) for x in met.tolist()}
            pairs -= seen  # one task meets the same rows under many keys
            seen = (seen if len(seen) < 100_000 else set()) | pairs
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])

    return _blocked(rows, "key", pivot=labels is None).mapInArrow(run, "a long, b long").distinct()


def cluster_links(near: DataFrame, labels: DataFrame, reps: DataFrame, texts: DataFrame, most: int, k: int, similarity: float) -> DataFrame:
    """Links (a, b) between components, on full sets, among the rows and forests of near_pairs()."""
    near = stage(near, "dup-near")
    of = labels.withColumnRenamed("label", "of")
    name = lambda rows, c: rows.join(of.withColumnRenamed("node", c), c, "left").withColumn(c, F.coalesce("of", c)).drop("of")
    clusters = components(name(name(near.filter("b IS NOT NULL"), "a"), "b").select("a", "b"))
    members = near.filter("b IS NULL").select(F.col("a").alias("rep"))
    members = members.join(of.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("of", "rep")).drop("of")
    members = stage(members.join(clusters.select(F.col("node").alias("label"), F.col("label").alias("cluster")), "label"), "dup-members")
    members = members.join(reps.select("rep", "signature", "n_shingles", "text_id"), "rep")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / TEXT_BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    rows = members.join(members.groupBy("cluster").agg(blocks.alias("blocks")), "cluster")
    rows = texts.join(rows.hint("merge"), "text_id").select("cluster", "blocks", "rep", "label", "signature", "text")
    hundredths = round(100 * similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "cluster", ("rep", "label", "own", "signature", "text")):
            rep, label, own, sig = _arrays(group)
            split, index, trees = own.min() != own.max(), np.arange(len(rep)), _Forest()
            sets: dict[int, np.ndarray] = {}
            out: tuple[list, list] = ([], [])
            for x in index:
                rest = index[(label != label[x]) & (index > x)]
                if split:
                    rest = rest[own[rest] != own[x]]
                for y in rest[(sig[rest] != sig[x]).sum(1) <= most]:
                    if trees.root(int(label[x])) == trees.root(int(label[y])):
                        continue
                    for z in (x, y):
                        if z not in sets:
                            sets[z] = next(shingle_sets(pa.array([group[z][4]], pa.large_string()), k))
                    if _linked(sets[x], sets[y], hundredths):
                        trees.join(int(label[x]), int(label[y]))
                        out[0].append(int(rep[x]))
                        out[1].append(int(rep[y]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["a", "b"])

    return stage(_blocked(rows, "cluster").mapInArrow(run, "a long, b long"), "dup-links")


def _linked(a: np.ndarray, b: np.ndarray, hundredths: int) -> bool:
    least, most = sorted((len(a), len(b)))
    if 100 * least < hundredths * most:
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= hundredths * (len(a) + len(b) - shared)


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text)."""
    docs, groups = docs.select("doc_id", "text"), position_groups(similarity)
    # rows are numbered where they are written: a set's representative is one row, however often its text repeats
    sets = stage(digests(docs, k).withColumn("text_id", F.monotonically_increasing_id()), "dup-sets")
    texts = sets.select("text_id", "text")
    full = sets.filter("set_id IS NOT NULL AND doc_id IS NOT NULL")
    reps = stage(full.groupBy("set_id").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "text_id")).alias("of"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")).select("set_id", "of.*", "signature", "n_shingles"), "dup-reps")
    keys = index_keys(reps, groups)
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    keys = stage(keys.join(shared, "key"), "dup-keys")
    # the first round only saves work for the second, so one key of each group does
    likely = stage(near_pairs(keys.filter("key & 1 = 1"), None, reps, round(POSITIONS * (1 - similarity))), "dup-likely")
    links = confirm(likely, reps, texts, k, similarity)
    labels = stage(components(links), "dup-labels")
    most = max_errors(similarity, POSITIONS)
    more = cluster_links(near_pairs(keys, labels, reps, most), labels, reps, texts, most, k, similarity)
    labels = stage(components(links.union(more)), "dup-labels")

    classes = reps.select("set_id", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set_id", F.coalesce("label", "rep").alias("component"))
    joined = sets.join(classes, "set_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("component", "doc_id"))
    out = joined.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _nodes(docs: DataFrame, name: str) -> DataFrame:
    """`docs` with a column `name`: the id, or another number above 2**62 for every further text of an id that has several.

    So each text is judged by itself, and a document whose number is its id stands before one whose number is not.
    """
    of, key, several_id, first = F.col("doc_id").cast("long"), F.xxhash64("text"), fresh(docs, "several_id"), fresh(docs, "first_key")
    several = docs.select(of.alias(several_id), key.alias("key")).groupBy(several_id).agg(F.min("key").alias(first), F.max("key").alias("top"))
    several = stage(several.filter(F.col(first) != F.col("top")).drop("top"), "dup-several")
    other = F.xxhash64(of, key).bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    node = F.when(F.col(first).isNull() | (F.col(first) == key), of).otherwise(other)
    return docs.join(several, of == F.col(several_id), "left").withColumn(name, node).drop(several_id, first)


def drop_near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that stand for their group, one for each id and text; rows with a null id all stay."""
    node = fresh(docs, "near_node")
    named = _nodes(docs.filter("doc_id IS NOT NULL"), node)
    kept = near_duplicates(named.select(F.col(node).alias("doc_id"), "text"), k, similarity).filter("kept").select(F.col("doc_id").alias(node)).distinct()
    one = named.join(kept, node, "left_semi").dropDuplicates([node]).select(*docs.columns)
    return one.unionByName(docs.filter("doc_id IS NULL"))
