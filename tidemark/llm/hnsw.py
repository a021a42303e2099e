"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors are stored once, with their k + 1 smallest ids. Distinct vectors are dealt by hash to shards of about
SHARD_ROWS; every row is indexed. A shard's graph lies in flat arrays of neighbour numbers, one for each layer: a node
is in layer l with chance LINKS**-l. Nodes are inserted in batches, those of the highest layers first: each searches the graph
that is there, from the top layer down, and in each of its layers links to diverse nodes among those found (a candidate
that is nearer to a link already chosen is passed over, and fills up only what room is left). Nodes linked to link
back; where one has no room left, its links are chosen anew by the same rule.

A search goes down the layers and keeps a beam of EF nodes in the lowest one, for a block of queries at once. A shard is sent
once: its queries stream past it. Every query visits every shard, so queries x shards rows are sent; with the queries a
fixed share of the rows these grow faster than the index. Sending a query only to the shards nearest to it was measured
and loses too much (README), so the shards are dealt by hash and none is passed over.

Scores are cosines of the original vectors in double precision. Vectors that are null, empty or zero, or that hold null
or non-finite components, take no part; vectors meet only those of their own length. An id that comes with several
vectors is searched with each of them, and a candidate counts with its best score.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

SHARD_ROWS, LINKS, EF, QUERY_BLOCK = 8192, 16, 128, 512
#: Beam of an insertion, most nodes inserted at once, and the nearest of them that a node of the batch considers.
EF_BUILD, BATCH, MATES = 48, 512, 16
#: Nodes that a step of a search opens at once.
OPENED = 4


def _choose(x: np.ndarray, nodes: np.ndarray, near: np.ndarray, keep: int) -> np.ndarray:
    """Up to `keep` diverse links of each of `nodes` among `near` (-1: none), nearest first among the chosen."""
    out = np.full((len(nodes), keep), -1, np.int32)
    for a in range(0, len(nodes), 1024):
        own, c = nodes[a : a + 1024], np.sort(near[a : a + 1024], axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == own[:, None]] = -1
        sim = np.where(c >= 0, np.einsum("nd,ncd->nc", x[own], x[c]), -np.inf)
        order = np.argsort(-sim, axis=1, kind="stable")
        c, sim = np.take_along_axis(c, order, 1), np.take_along_axis(sim, order, 1)
        z = x[c]
        among = z @ z.transpose(0, 2, 1)
        chosen, blocked, count = np.zeros(c.shape, bool), np.full(c.shape, -np.inf, np.float32), np.zeros(len(c), int)
        for k in range(c.shape[1]):
            take = (sim[:, k] > blocked[:, k]) & (count < keep)
            chosen[:, k] = take
            count += take
            blocked = np.where(take[:, None], np.maximum(blocked, among[:, k, :]), blocked)
        picked = np.take_along_axis(c, np.argsort(~chosen, axis=1, kind="stable")[:, :keep], 1)
        out[a : a + 1024, : picked.shape[1]] = picked
    return out


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Each vector times the power of two that brings its largest component near 1: no cosine changes, and no square over- or underflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True, initial=0))[1]) if vectors.size else vectors


def _unit(vectors: np.ndarray) -> np.ndarray:
    x = _scaled(vectors)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


class Graph:
    """layers[0] holds all nodes; each layer is (its nodes in rising order, their neighbour table)."""

    def __init__(self, unit: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]):
        self.unit, self.layers = unit, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 11) -> Graph:
        unit = _unit(vectors)
        level = np.floor(-np.log(np.random.default_rng(seed).random(len(unit))) / np.log(LINKS)).astype(int)
        layers = []
        for l in range(level.max() + 1):
            nodes = np.flatnonzero(level >= l).astype(np.int32)
            layers.append((nodes, np.full((len(nodes), 2 * LINKS if l == 0 else LINKS), -1, np.int32)))
            if len(nodes) <= LINKS:
                break
        graph, level = cls(unit, layers), np.minimum(level, len(layers) - 1)
        order, at = np.argsort(-level, kind="stable").astype(np.int32), 0
        while at < len(order):
            batch = order[at : at + min(max(at, LINKS), BATCH)]
            graph._insert(batch, level[batch], order[:at])
            at += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, level: np.ndarray, there: np.ndarray) -> None:
        """Add nodes to their layers; nodes of the top layer went in first, so every search has where to start."""
        entry = there[np.isin(there[:LINKS], self.layers[-1][0]).nonzero()[0]]
        start = np.full((len(batch), LINKS), -1, np.int32)
        start[:, : len(entry)] = entry
        for layer in range(len(self.layers) - 1, -1, -1):
            found = self._beam(self.unit[batch], layer, start, EF_BUILD)
            start = found[:, :LINKS]
            mine = level >= layer
            if mine.any():
                self._link(layer, batch[mine], found[mine])

    def _link(self, layer: int, new: np.ndarray, found: np.ndarray) -> None:
        x, (nodes, table) = self.unit, self.layers[layer]
        width, half = table.shape[1], table.shape[1] // 2
        sim = x[new] @ x[new].T
        np.fill_diagonal(sim, -np.inf)
        mates = new[np.argpartition(-sim, min(MATES, len(new) - 1), axis=1)[:, :MATES]]
        links = _choose(x, new, np.concatenate([found, mates], 1), half)
        table[np.searchsorted(nodes, new), :half] = links
        to, source = links.ravel(), np.repeat(new, half)
        to, source = to[to >= 0], source[to >= 0]
        order = np.lexsort((-np.einsum("ij,ij->i", x[to], x[source]), to))
        to, source = to[order], source[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        ends, at = np.unique(to, return_inverse=True)
        back = np.full((len(ends), width), -1, np.int32)
        ok = place < width
        back[at[ok], place[ok]] = source[ok]
        row = np.searchsorted(nodes, ends)
        table[row] = _choose(x, ends, np.concatenate([table[row], back], 1), width)

    def _beam(self, q: np.ndarray, layer: int, start: np.ndarray, width: int) -> np.ndarray:
        """The nearest nodes found to each query, best first, from the start nodes (-1: none); a step opens the OPENED best
        nodes of a beam that were not opened yet."""
        nodes, table = self.layers[layer]
        row = np.full(len(self.unit), -1, np.int32)
        row[nodes] = np.arange(len(nodes), dtype=np.int32)
        m = len(q)
        lines = np.arange(m)[:, None]
        seen = np.zeros((m, len(self.unit) + 1), bool)
        seen[:, -1] = True
        seen[lines, start] = True
        place = np.zeros((m, len(self.unit) + 1), np.int16)
        sim = np.where(start >= 0, np.einsum("qd,qkd->qk", q, self.unit[start]), -np.inf)
        pad = max(0, width - start.shape[1])
        ids = np.pad(start, ((0, 0), (0, pad)), constant_values=-1)
        sim = np.pad(sim, ((0, 0), (0, pad)), constant_values=-np.inf)
        done = ids < 0
        active, opened = np.arange(m), min(OPENED, ids.shape[1])
        at = np.arange(opened * table.shape[1], dtype=np.int16)
        while len(active):
            wait = np.where(done[active], -np.inf, sim[active])
            best = np.argpartition(-wait, opened - 1, axis=1)[:, :opened]
            go = np.isfinite(np.take_along_axis(wait, best, 1))
            some = go.any(1)
            active, best, go = active[some], best[some], go[some]
            if not len(active):
                break
            own = active[:, None]
            done[own, best] = True
            near = np.where(go[:, :, None], table[row[ids[own, best]]], -1).reshape(len(active), -1)
            fresh = ~seen[own, near]
            seen[own, near] = True
            # of a node that several of them link to, one is taken
            place[own, near] = at
            fresh &= place[own, near] == at
            s = np.where(fresh, np.einsum("qd,qkd->qk", q[active], self.unit[near]), -np.inf)
            all_ids, all_sim = np.concatenate([ids[active], near], 1), np.concatenate([sim[active], s], 1)
            top = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
            sim[active], line = np.take_along_axis(all_sim, top, 1), np.arange(len(active))[:, None]
            ids[active] = np.where(np.isfinite(sim[active]), all_ids[line, top], -1)
            done[active] = np.concatenate([done[active], ~fresh], 1)[line, top]
        order = np.argsort(-sim, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1)

    def search(self, queries: np.ndarray, k: int, ef: int = EF) -> np.ndarray:
        """Numbers of about the k nearest nodes of each query, -1 where there are fewer."""
        q = _unit(queries)
        top = self.layers[-1][0]
        start = np.repeat(top[None, :], len(q), 0)[:, : max(LINKS, 1)]
        for layer in range(len(self.layers) - 1, 0, -1):
            start = self._beam(q, layer, start, LINKS)
        return self._beam(q, 0, start, max(ef, k))[:, :k]

    def to_row(self) -> dict:
        return {"layers": [{"nodes": n.astype("<i4").tobytes(), "links": t.astype("<i4").tobytes(), "width": t.shape[1]} for n, t in self.layers]}

    @classmethod
    def from_row(cls, vectors: np.ndarray, layers: list[dict]) -> Graph:
        unit = _unit(vectors)
        return cls(unit, [(np.frombuffer(x["nodes"], "<i4"), np.frombuffer(x["links"], "<i4").reshape(-1, x["width"])) for x in layers])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, each pair once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.filter("vec_id IS NOT NULL").filter(finite).dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.stack([np.asarray(x.values) for x in column]) if len(column) else np.zeros((0, 0))


_INDEX = "dim int, shard long, vectors binary, ids array<array<long>>, layers array<struct<nodes:binary,links:binary,width:int>>"


def build_index(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """One row for each shard, staged, and the number of shards. Equal vectors carry their k + 1 smallest ids."""
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    held = rows.withColumn("rn", first).filter(F.col("rn") <= k + 1)
    distinct = stage(held.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "ann-distinct")
    shards = max(1, -(-distinct.count() // shard_rows))
    dealt = distinct.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("long").alias("shard"), "v", "ids")

    def build(key: tuple, t: pa.Table) -> pa.Table:
        ids = t["ids"].to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i][0], ids[i]))
        vectors = _matrix(t["v"])[order]
        row = {"dim": key[0].as_py(), "shard": key[1].as_py(), "vectors": vectors.astype("<f8").tobytes(), "ids": [ids[i] for i in order], **Graph.build(vectors).to_row()}
        layer = pa.struct([("nodes", pa.binary()), ("links", pa.binary()), ("width", pa.int32())])
        return pa.Table.from_pylist([row], pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("layers", pa.list_(layer))]))

    # a fixed number of partitions: small as shards are, building them is work for a task each
    return stage(dealt.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, _INDEX), "ann-index"), shards


def nearest(queries: DataFrame, index: DataFrame, shards: int, k: int = 5, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id, score of each query row (vec_id, v): its k nearest found, never itself."""
    asked = queries.select(
        F.size("v").alias("dim"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.col("vec_id").alias("query_id"), "v",
        *[F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("vectors", "ids", "layers")],
    )
    held = index.select("dim", "shard", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<double>").alias("v"), "vectors", "ids", "layers")
    rows = held.union(asked).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("query_id").asc_nulls_first())
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def look(shard: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        vectors, norms, ids, graph = shard
        q, own = _scaled(_matrix(part.column("v"))), part.column("query_id").to_pylist()
        found, qn = graph.search(q, min(2 * k + 2, len(vectors)), ef), np.linalg.norm(q, axis=1)
        out: list[tuple] = []
        for i, near in enumerate(found):
            near = near[near >= 0]
            scores = (vectors[near] * q[i]).sum(1) / (norms[near] * qn[i])
            best: dict[int, float] = {}
            for n, s in zip(near.tolist(), scores.tolist()):
                for v in ids[n]:
                    if v != own[i]:
                        best[v] = max(s, best.get(v, -2.0))
            out += [(own[i], v, s) for v, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([], [], []), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's graph, then its queries in blocks; queries of a length that no vector has meet no graph."""
        at, shard = None, None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard")])
            graphs = batch.column("query_id").is_null().to_numpy(zero_copy_only=False)
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0) | graphs[1:] | graphs[:-1]) + 1
            for a, b in itertools.pairwise([0, *new.tolist(), batch.num_rows]):
                if graphs[a]:
                    row = batch.slice(a, 1).to_pylist()[0]
                    vectors = _scaled(np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"]))
                    at, shard = keys[:, a].tolist(), (vectors, np.linalg.norm(vectors, axis=1), row["ids"], Graph.from_row(vectors, row["layers"]))
                elif at == keys[:, a].tolist():
                    for c in range(a, b, QUERY_BLOCK):
                        yield look(shard, batch.slice(c, min(QUERY_BLOCK, b - c)))

    found = rows.mapInArrow(run, "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
