"""Byte-level BPE by prefix dynamic programming.

Every byte prefix of a piece (a match of the splitting pattern) has exactly one encoding, and a sequence of tokens is the
encoding of its bytes just when each two neighbours are the encoding of theirs. So one number a byte is enough: the last
token of the prefix that ends there. It is the one token that ends there and goes with the last token of the prefix before
it. The ids of any prefix are read off backwards. A prefix's entry never depends on bytes behind it, so an append goes on
where the table ends, and an edit computes entries from its first byte on until the pieces fall on the old borders again.

``encode`` gives the ids, ``encode_prefixes`` the table as well (one 32-bit number a byte, ~token where a piece ends),
``revise`` applies one edit a row to a stored table, ``decode`` gives the bytes back. All work row by row: no shuffle.

Null and empty texts have no ids; a null edit (any part null) leaves a row as it is. Repeated rows are encoded row by row. A very
long text is split lazily, and one long piece costs time in proportion to its length (times at most the longest token).
`path` must lead to the rank file on every machine.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Entries of each memory of a worker, and the longest piece that it keeps.
_MEMORY, _KEPT_CHARS = 400_000, 64
_BATCH_BYTES = 2 << 20
#: Bytes ahead of an edit whose pieces are split again: a piece depends on two characters behind its end.
_LOOK = 8


class Memory(dict):
    """Results of a function of one value; emptied when full. Values that `keep` refuses are computed each time."""

    def __init__(self, f: Callable, keep: Callable = lambda _: True):
        self.f, self.keep = f, keep

    def __missing__(self, key):
        value = self.f(key)
        if self.keep(key):
            if len(self) >= _MEMORY:
                self.clear()
            self[key] = value
        return value


class ByteBPE:
    """A vocabulary of byte strings with ranks; a rank is the token's id."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, rank in self.ids.items():
            self.tokens[rank] = token
        self.lengths = [len(t) for t in self.tokens]
        self.sizes = np.array(self.lengths, np.int64)
        self.longest, self.width = max(map(len, self.ids)), len(self.tokens)
        #: Finds all tokens that end at each byte, one character a byte.
        self.endings = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.endings.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.endings.make_automaton()
        self.pattern = regex.compile(pattern)
        self.fits = Memory(self._fits)
        self.alone = Memory(lambda token: self.merged(self.tokens[token]) == [token])
        short = lambda piece: len(piece) <= _KEPT_CHARS
        self.piece_ids = Memory(lambda piece: array("i", self.read(self.table(piece.encode()))).tobytes(), short)
        self.piece_table = Memory(lambda piece: self._closed(self.table(piece.encode())), short)

    def merged(self, piece: bytes) -> list[int]:
        """The ids by merging the pair of least rank until none is left. Only asked for two tokens on end."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranks = [self.ids.get(a + b, len(self.tokens)) for a, b in zip(parts, parts[1:])]
            best = min(ranks, default=len(self.tokens))
            if best == len(self.tokens):
                return [self.ids[p] for p in parts]
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _fits(self, pair: int) -> bool:
        """Whether two tokens may stand side by side (first * width + second)."""
        a, b = divmod(pair, self.width)
        return self.merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def table(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix of a piece; `known` holds those of its first bytes."""
        last, fits, width = list(known or ()), self.fits, self.width
        done = len(last)
        text = piece.decode("latin-1")
        # each byte ends one token that goes with what stands before it, or that stands alone and merges to itself
        for end, (token, back) in self.endings.iter(text, max(done + 1 - self.longest, 0)):
            if end == done:
                start = end - back
                if fits[last[start - 1] * width + token] if start else self.alone[token]:
                    last.append(token)
                    done += 1
        return last

    def read(self, last) -> list[int]:
        """The ids of the prefix that a table covers."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= self.lengths[last[at - 1]]
        return out[::-1]

    @staticmethod
    def _closed(last: list[int]) -> bytes:
        return array("i", last[:-1] + [~last[-1]]).tobytes()

    def _each(self, text: str, memory: Memory) -> bytes:
        if len(text) <= 1 << 20:
            return b"".join(map(memory.__getitem__, self.pattern.findall(text)))
        found, out = self.pattern.finditer(text), bytearray()
        while part := [m[0] for m in islice(found, 1 << 16)]:
            out += b"".join(map(memory.__getitem__, part))
        return bytes(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as 32-bit numbers on end."""
        return self._each(text, self.piece_ids)

    def prefixes(self, text: str) -> bytes:
        """The table of a text, one 32-bit number a byte: the last token, its complement where a piece ends."""
        return self._each(text, self.piece_table)

    def ids_of(self, table: bytes) -> bytes:
        """The ids that a table of whole pieces stands for."""
        flat = np.frombuffer(table, np.int32)
        return array("i", self.read(np.where(flat < 0, ~flat, flat).tolist())).tobytes()

    def revise(self, text: str, table: bytes, start: int, stop: int, insert: str) -> tuple[str, bytes]:
        """The text with code points start..stop replaced, and its table: only pieces near the edit are computed again."""
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        old, raw = np.frombuffer(table, np.int32), text.encode()
        a = len(text[:start].encode())
        b, new = a + len(text[start:stop].encode()), insert.encode()
        borders = np.concatenate(([0], np.flatnonzero(old < 0) + 1))
        at = int(borders[max(int(np.searchsorted(borders, a - _LOOK, "right")) - 1, 0)])
        shift, behind = len(new) - (b - a), a + len(new)
        after, known = raw[:a] + new + raw[b:], set(borders.tolist())
        parts, here = [table[: 4 * at]], at
        for m in self.pattern.finditer(after[at:].decode()):
            if here >= behind and here - shift in known:
                break
            piece = m[0].encode()
            # entries ahead of the edit stay true for a piece that starts where one started before
            kept = old[here : min(here + len(piece), a)] if here < a and here in known else old[:0]
            kept = kept[: int(np.flatnonzero(kept < 0)[0]) + 1] if (kept < 0).any() else kept
            parts.append(self._closed(self.table(piece, np.where(kept < 0, ~kept, kept).tolist())))
            here += len(piece)
        parts.append(table[4 * (here - shift) :] if here < len(after) else b"")
        return text[:start] + insert + text[stop:], b"".join(parts)


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> ByteBPE:
    """The vocabulary, read once a worker."""
    return ByteBPE(path, pattern)


def _parts(batch: pa.RecordBatch, size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about _BATCH_BYTES each; a larger row stands alone."""
    upto = np.concatenate(([0], np.cumsum(size(batch))))
    i = 0
    while i < batch.num_rows:
        j = max(int(np.searchsorted(upto, upto[i] + _BATCH_BYTES, "right")) - 1, i + 1)
        yield batch.slice(i, j - i)
        i = j


def _bytes(column: str) -> Callable[[pa.RecordBatch], np.ndarray]:
    import pyarrow.compute as pc

    return lambda batch: pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)


def _lists(parts: list[bytes]) -> pa.Array:
    """An array of lists of 32-bit numbers."""
    offsets = np.concatenate(([0], np.cumsum([len(p) // 4 for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))]))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of `docs` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for part in _parts(batch, _bytes("text")):
                ids = [bpe.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(ids)], ["doc_id", "ids"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode_prefixes(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text (null becomes empty) and prefixes (binary) of every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for part in _parts(batch, _bytes("text")):
                texts = [t or "" for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array([bpe.prefixes(t) for t in texts], pa.binary())], ["doc_id", "text", "prefixes"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, T.StructType([docs.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("prefixes", T.BinaryType())]))


def revise(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text, prefixes and ids after one edit a row: `rows` has doc_id, text, prefixes, start, stop (code points) and insert.

    Start and stop beyond the text mean its end, so an append has both there. Several edits of a text are applied one after another.
    """
    wide = rows.select("doc_id", "text", "prefixes", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), "insert")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for part in _parts(batch, _bytes("prefixes")):
                texts, tables = [], []
                for row in zip(*(part.column(c).to_pylist() for c in ("text", "prefixes", "start", "stop", "insert"))):
                    text, table = row[0] or "", row[1] or b""
                    if None not in row[2:]:
                        text, table = bpe.revise(text, table, *row[2:])
                    texts.append(text)
                    tables.append(table)
                ids = _lists([bpe.ids_of(t) for t in tables])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string()), pa.array(tables, pa.binary()), ids], ["doc_id", "text", "prefixes", "ids"])

    fields = [wide.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("prefixes", T.BinaryType()), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    return wide.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (binary) of every row of `encoded` (doc_id, ids); null ids decode to no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path, pattern)
        for batch in batches:
            for part in _parts(batch, lambda b: 16 * np.diff(_offsets(b.column("ids")))):
                ids, offsets = part.column("ids"), _offsets(part.column("ids"))
                flat = ids.flatten().to_numpy()
                upto = np.concatenate(([0], np.cumsum(bpe.sizes[flat])))[offsets].astype(np.int32)
                raw = b"".join(map(bpe.tokens.__getitem__, flat.tolist()))
                decoded = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(upto.tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids, decoded], ["doc_id", "ids", "decoded"])

    encoded = encoded.select("doc_id", "ids")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def _offsets(lists: pa.Array) -> np.ndarray:
    """Offsets of the lists in their values on end, from 0; a null list has none."""
    import pyarrow.compute as pc

    return np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))).astype(np.int64)
