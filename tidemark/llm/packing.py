"""Packing documents into token windows by best-fit decreasing.

A document's ids are its text's, by the tokenizer file, then id END. It is first cut into full windows; what is left
over is packed: pieces in order of falling length, each into the open window with the least room that holds it. The
open windows lie in a segment tree indexed by remaining capacity, so the tightest one is found in log(window) steps.

Pieces are dealt to shards by a hash of document and position, about SHARD_TOKENS tokens a shard, and packed shard by
shard; a shard leaves a few windows part full. Sequence ids carry the shard in their upper bits.

Null and empty texts have only the END id. Repeated rows are packed row by row. Very long texts are tokenized whole.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

WINDOW, END = 2048, 1
SHARD_TOKENS = 4 << 20
_CACHE_WORDS = 500_000
_BATCH_BYTES = 2 << 20
#: Plain letters, then marks of ASCII that are neither letter, digit nor space: these never join with letters.
_PARTS = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<mark>[!-/:-@\\[-`{-~]*)$"


#: Texts on which the rules of WordTokenizer are tried.
SAMPLES = ("Two Words", " Lead,  and\ttrail.\n\nNext (one) ", "ÀÉ été Straße's", "a1b2 3.14 x-y", "the quick brown Fox jumps; over")


class WordTokenizer:
    """Ids of whole texts from a file of the `tokenizers` library, word by word.

    Holds for tokenizers that lower-case, drop white space, never join over it and part letters from other marks: then
    a text's ids are its words' ids on end, and those of "Word.)" are those of "word" and ".)". Other files, told by
    samples (SAMPLES), are applied to whole texts. Words met before come from
    bounded tables. New words of plain letters are encoded together, parted by spaces, and told apart by their end
    tokens; all others are encoded one by one as they stand.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same vocabulary and merges for lower-case letters, on which its normalizers and splits do nothing more
        self.letters = Tokenizer.from_file(path)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.by_words = bool(self.ends.any()) and all(self._parted(t) for t in SAMPLES)

    def _parted(self, text: str) -> bool:
        """Whether the text's ids are those of its words on end, and a word's those of its small letters and its marks."""
        pieces = []
        for word in text.split():
            m = re.match(_PARTS, word)
            pieces += [m["core"].lower(), m["mark"]] if m else [word]
        return self._whole(text) == b"".join(map(self._whole, pieces))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, cores: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for i in range(0, len(cores), 400):
            part = cores[i : i + 400]
            ids = np.array(self.letters.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(cuts) != len(part):
                out.update((w, self._whole(w)) for w in part)
                continue
            raw, at = ids.tobytes(), 0
            for w, cut in zip(part, cuts):
                out[w] = raw[4 * at : 4 * cut]
                at = cut
        return out

    def _look_up(self, names: list[str], learn) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all names on end, number of ids of each)."""
        ids = list(map(self.known.get, names))
        gaps = [i for i, x in enumerate(ids) if x is None]
        if gaps:
            new = learn([names[i] for i in gaps])
            for i in gaps:
                ids[i] = new[names[i]]
            if len(self.known) < _CACHE_WORDS:
                self.known.update(new)
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, the n + 1 places where texts begin).

        Distinct words of a batch are split into letters and marks; the distinct parts are looked up once.
        """
        if not self.by_words:
            ids = [self._whole(t or "") for t in texts.to_pylist()]
            return np.frombuffer(b"".join(ids), "<u4"), np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)])
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        names, each = words.dictionary, words.indices.to_numpy()
        parts = pc.extract_regex(names, _PARTS)
        plain = parts.is_valid()
        core = pc.if_else(plain, pc.utf8_lower(parts.field("core")), names).dictionary_encode()
        mark = pc.if_else(plain, parts.field("mark"), "").dictionary_encode()
        letters = np.zeros(len(core.dictionary), bool)
        letters[core.indices.to_numpy()[plain.to_numpy(zero_copy_only=False)]] = True
        keys = core.dictionary.to_pylist()

        def learn(fresh: list[str]) -> dict[str, bytes]:
            is_plain = dict(zip(keys, letters.tolist()))
            out = self._plain([w for w in fresh if is_plain[w]])
            out.update((w, self._whole(w)) for w in fresh if not is_plain[w])
            return out

        a, a_size = self._look_up(keys, learn)
        b, b_size = self._look_up(mark.dictionary.to_pylist(), lambda fresh: {m: self._whole(m) for m in fresh})
        pool, size = np.concatenate([a, b]), np.concatenate([a_size, b_size])
        first = np.cumsum(size) - size
        # each word is its letters, then its marks
        piece = np.stack([core.indices.to_numpy()[each], mark.indices.to_numpy()[each].astype(np.int64) + len(a_size)], 1).ravel()
        n = size[piece]
        ends = np.concatenate([[0], np.cumsum(n)])
        out = pool[np.arange(ends[-1]) + np.repeat(first[piece] - ends[:-1], n)]
        return out, ends[2 * (np.asarray(split.offsets) - split.offsets[0].as_py())]


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> WordTokenizer:
    """The tokenizer of a worker process: tasks that follow find its tables filled."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece: full windows and a rest of each row of `docs`."""
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_string())
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy())
            i = 0
            while i < len(texts):
                done = int(size[i - 1]) if i else 0
                j = min(max(int(np.searchsorted(size, done + _BATCH_BYTES, side="right")), i + 1), len(texts))
                ids, at = tokenizer.encode(texts.slice(i, j - i))
                out: list[list] = [[], [], [], []]
                for k in range(j - i):
                    raw = ids[at[k] : at[k + 1]].tobytes() + end
                    n = len(raw) // 4
                    for start in range(0, n, window):
                        piece = raw[4 * start : 4 * (start + window)]
                        for column, x in zip(out, (k, start, zlib.crc32(piece), n), strict=True):
                            column.append(x)
                k, start, crc, n = (np.array(x, np.int64) for x in out)
                doc_id = batch.column("doc_id").take(pa.array(k + i))
                yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, (start, np.minimum(n - start, window), crc, n))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
                i = j

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


class OpenWindows:
    """A segment tree over remaining capacities 1..window: a node is on where some open window below it has that room."""

    def __init__(self, window: int):
        self.base = 1
        while self.base < window + 1:
            self.base *= 2
        self.on = bytearray(2 * self.base)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def tightest(self, length: int) -> int:
        """The least capacity of at least `length` that an open window has; 0 if none."""
        on, node = self.on, self.base + length
        if on[node]:
            return length
        while node > 1:
            if not node & 1 and on[node + 1]:
                node += 1
                while node < self.base:
                    node = 2 * node if on[2 * node] else 2 * node + 1
                return node - self.base
            node >>= 1
        return 0

    def push(self, capacity: int, window_id: int) -> None:
        if capacity <= 0:
            return
        self.stacks[capacity].append(window_id)
        node = self.base + capacity
        while node and not self.on[node]:
            self.on[node] = 1
            node >>= 1

    def pop(self, capacity: int) -> int:
        found = self.stacks[capacity].pop()
        node = self.base + capacity
        if not self.stacks[capacity]:
            self.on[node] = 0
            node >>= 1
            while node and not (self.on[2 * node] or self.on[2 * node + 1]):
                self.on[node] = 0
                node >>= 1
        return found


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; `lengths` must fall or stay."""
    tree, used = OpenWindows(window), []
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        room = tree.tightest(n)
        if room:
            k = tree.pop(room)
        else:
            k, room = len(used), window
            used.append(0)
        where[i], offset[i] = k, used[k]
        used[k] += n
        tree.push(room - n, k)
    return where, offset


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every row of `docs`."""
    cut = stage(pieces(docs, path, window), "pack-pieces")
    total = cut.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    # all pieces of equal rows share a hash: their number within it, modulo a shard's worth, deals them on
    copies = F.row_number().over(Window.partitionBy("doc_id", "start", "ids_crc32").orderBy("length"))
    dealt = cut.withColumn("copy", F.floor(copies / 256)).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "copy"), F.lit(shards)).cast("long")).drop("copy")
    rows = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.desc("length"), "doc_id", "start", "ids_crc32")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def finish(shard: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        where, offset = best_fit_decreasing(t["length"].to_numpy(), window)
        columns = [t[c].combine_chunks() if isinstance(t[c], pa.ChunkedArray) else t[c] for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(where + (shard << 32)), pa.array(offset)], [*names, "sequence_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if shard[a] != at and held:
                    yield finish(at, held)
                    held = []
                at = int(shard[a])
                held.append(batch.slice(a, b - a).select(names))
        if held:
            yield finish(at, held)

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
