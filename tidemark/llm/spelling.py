"""Grouping spelling variants by rare-first prefixes of positional bigrams.

Two words that differ by one code point keep all bigrams but two of each in common, so of the three rarest bigrams of both (one
order for all words: by frequency, then by bigram, then by position) at least one is shared. Words are joined on these
three only, under position limits that follow from a single edit: the shared bigram stands at the same place and the
words agree up to its end, or at the same distance from the end and they agree from it on. The length of the longer
word, the place and the part that agrees are in the key. What is left is verified code point by code point.

Groups of up to GROUP words with one key are paired inside their row. A larger group is split by what its words are without one code point
of the part that may differ (64-bit hashes, then verified): two words share such a remainder at one place, or one word
is the other's remainder, just when they are near. At most an alphabet of words shares a remainder at a place, so no
group's work grows with the square of its size, and no link is lost.

Words are strings of Latin-1 letters (code points below 256; others are an error), so there are at most 65,536 bigrams: their counts are
the only thing that the driver sees. Null texts have no words, null ids count as empty ones, repeated rows count as often as they come, and null or
short words of a caller's table are left out. A long word gives three bigrams like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import _tables, mix, texts_of
from tidemark.plans.staging import stage

RUN, MIN_CHARS, MIN_COUNT, MODULUS = "[A-Za-z\\u00C0-\\u00FF]+", 5, 3, 97
GROUP = 32
#: Bytes of words handled in one numpy step.
_SLICE = 1 << 18
_U = np.uint64
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def corpus_words(docs: DataFrame, modulus: int = MODULUS, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words of all texts of `docs` (doc_id, text). Of every `modulus`-th run by the hash of id and run one
    code point is left out, as a slip of the pen would."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.translate("text", _UPPER, _UPPER.lower()), F.lit(RUN), F.lit(0))).alias("run"))
    # a slip only shortens a run
    runs = runs.filter(F.length("run") >= min_chars).select("run", F.crc32(F.encode(F.concat_ws(":", "id", "run"), "UTF-8")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slip = F.concat(F.left("run", at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % modulus == 0, slip).otherwise(F.col("run"))
    return runs.select(word.alias("word")).filter(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte a code point of all words on end, and the n + 1 offsets."""
    raw, offsets = texts_of(column)
    lead = (raw & 0xC0) != 0x80
    if (raw > 0xC3).any():
        raise ValueError("words must be of code points below 256")
    chars = raw[lead].astype(np.uint8)
    two = np.flatnonzero(chars >= 0xC2)
    places = np.flatnonzero(lead)[two]
    chars[two] = ((raw[places] & 3) << 6) | (raw[places + 1] & 0x3F)
    return chars, np.concatenate(([0], np.cumsum(lead)))[offsets]


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of words of about _SLICE bytes: first, end, code points, offsets; a longer word stands alone."""
    _, upto = texts_of(column)
    i = 0
    while i < len(column):
        j = max(int(np.searchsorted(upto, upto[i] + _SLICE, "right")) - 1, i + 1)
        yield (i, j, *_latin(column.slice(i, j - i)))
        i = j


def _bigrams(chars: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and place of each bigram that lies within one word, words in order."""
    inside = np.ones(max(len(chars) - 1, 0), bool)
    ends = offsets[1:-1] - 1
    inside[ends[ends < len(inside)]] = False
    place = np.flatnonzero(inside)
    return chars[place].astype(np.int32) * 256 + chars[place + 1], place


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """Rank of each of the 65,536 possible bigrams, the rarest first; at most as many rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, chars, offsets in _slices(batch.column("word")):
                total += np.bincount(_bigrams(chars, offsets)[0], minlength=1 << 16)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["gram", "n"])

    rows = words.select("word").mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(1 << 16, np.int64)
    for r in rows:
        total[r.gram] = r.n
    ranks = np.empty(1 << 16, np.int64)
    ranks[np.lexsort((np.arange(1 << 16), total))] = np.arange(1 << 16)
    return ranks


class _Sums:
    """Hashes of spans of code points: polynomials over the code points of one slice, modulo 2**64."""

    def __init__(self, chars: np.ndarray):
        self.power, self.inverse = _tables(len(chars) + 1)
        self.sums = np.zeros(len(chars) + 1, _U)
        np.cumsum((chars.astype(_U) + _U(1)) * self.power[: len(chars)], out=self.sums[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def without(self, start: np.ndarray, end: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of start..end without the code point at `at`."""
        return ((self.sums[at] - self.sums[start]) + (self.sums[end] - self.sums[at + 1]) * self.inverse[1]) * self.inverse[start]


def _keys(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """word, n and, for each of its three rarest bigrams, four rows of key, longer (whether the word plays the longer one, or one
    as long), lo and hi (where the other word may differ)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, chars, offsets in _slices(batch.column("word")):
                gram, place = _bigrams(chars, offsets)
                owner = np.searchsorted(offsets, place, "right") - 1
                order = np.lexsort((place, ranks[gram], owner))
                first = np.searchsorted(owner, np.arange(j - i))
                keep = order[np.arange(len(order)) - first[owner[order]] < 3]
                gram, place, owner = gram[keep].astype(_U), place[keep], owner[keep]
                start, end, sums = offsets[owner], offsets[owner + 1], _Sums(chars)
                size, at = (end - start).astype(_U), (place - start).astype(_U)
                head, tail = sums.span(start, place + 2), sums.span(place, end)
                parts = []
                for side, same in ((0, head), (1, tail)):
                    for longer in (1, 0):
                        # in a word one longer, the place is the same or, with the edit before it, one on
                        where, length = at + _U(side * (1 - longer)), size + _U(1 - longer)
                        key = mix(same + mix(gram + (where << _U(18)) + mix(length * _U(2) + _U(side))))
                        lo, hi = (place + 2 - start, end - start) if side == 0 else (place - place, place - start)
                        parts.append((owner + i, key.view(np.int64), np.full(len(owner), longer, np.int32), lo, hi))
                row, key, longer, lo, hi = (np.concatenate(p) for p in zip(*parts))
                taken = batch.select(["word", "n"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(key), pa.array(longer), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["word", "n", "key", "longer", "lo", "hi"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, key long, longer int, lo int, hi int")


def _remainders(rows: DataFrame) -> DataFrame:
    """For a longer word, a row for each place that may differ with the hash of the word without it; for a shorter one, its own hash (place -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, hi, longer = (batch.column(c).to_numpy() for c in ("lo", "hi", "longer"))
            for i, j, chars, offsets in _slices(batch.column("word")):
                sums, big = _Sums(chars), np.flatnonzero(longer[i:j] == 1)
                count = (hi[i:j] - lo[i:j])[big]
                row = np.repeat(big, count)
                place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + lo[i:j][row]
                cut = sums.without(offsets[row], offsets[row + 1], offsets[row] + place)
                small = np.flatnonzero(longer[i:j] == 0)
                whole = sums.span(offsets[small], offsets[small + 1])
                every = np.concatenate((row, small))
                for a in range(0, len(every), 1 << 14):
                    part = slice(a, a + (1 << 14))
                    taken = batch.select(["word", "n", "key", "longer"]).take(pa.array(every[part] + i))
                    h, at = np.concatenate((cut, whole))[part], np.concatenate((place, np.full(len(small), -1)))[part]
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(mix(h).view(np.int64)), pa.array(at.astype(np.int32))], ["word", "n", "key", "longer", "rest", "at"])

    return rows.select("word", "n", "key", "longer", "lo", "hi").mapInArrow(run, "word string, n long, key long, longer int, rest long, at int")


def _one_edit(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Whether the words of `a` (code points, offsets) are one edit from those of `b`, which are as long or one shorter; in linear time."""
    size, less = np.diff(b_at), np.diff(a_at) - np.diff(b_at)
    own = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(b)) - b_at[own]
    left = a_at[own] + place
    here = a[left] != b
    shifted = a[left + less[own]] != b
    # one longer: alike ahead of the extra code point, and one on behind it
    first, last = size.copy(), np.full(len(size), -1)
    np.minimum.at(first, own[here], place[here])
    np.maximum.at(last, own[shifted], place[shifted])
    return np.where(less == 1, last < first, (less == 0) & (np.bincount(own[here], minlength=len(size)) == 1))


def _verified(pairs: DataFrame) -> DataFrame:
    """The pairs a, a_n, b, b_n (`a` as long as `b` or one longer) that are one edit apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, chars, offsets in _slices(batch.column("a")):
                part = batch.slice(i, j - i)
                yield part.filter(pa.array(_one_edit(chars, offsets, *_latin(part.column("b")))))

    return pairs.mapInArrow(run, pairs.schema)


def _paired(groups: DataFrame, fits) -> DataFrame:
    """a, a_n, b, b_n: each longer word of a group's `members` with those that it fits."""
    first = groups.select("members", F.explode(F.filter("members", lambda m: m["longer"] == 1)).alias("x"))
    other: Column = F.filter("members", lambda m: fits(F.col("x"), m))
    both = first.select("x", F.explode(other).alias("y")).filter(F.length("x.word") - F.length("y.word") == 1 - F.col("y.longer"))
    return both.select(F.col("x.word").alias("a"), F.col("x.n").alias("a_n"), F.col("y.word").alias("b"), F.col("y.n").alias("b_n"))


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """a, a_n, b, b_n of every two words of `words` (word, n; words distinct, at least five code points) that differ by one inserted, deleted or
    replaced code point. A pair comes in one direction, possibly more than once."""
    words = words.select("word", "n").filter(F.length("word") >= MIN_CHARS)
    rows = stage(_keys(words, bigram_ranks(words)), "spell-keys")
    crowd = stage(rows.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > group).select("key"), "spell-large")
    few = rows.join(crowd, "key", "left_anti").groupBy("key").agg(F.collect_list(F.struct("word", "n", "longer")).alias("members"))
    few = _paired(few.filter(F.size("members") > 1), lambda x, m: (m["longer"] == 0) | (m["word"] > x["word"]))
    split = _remainders(rows.join(crowd, "key", "left_semi"))
    split = split.groupBy("key", "rest").agg(F.collect_list(F.struct("word", "n", "longer", "at")).alias("members"))
    split = _paired(split.filter(F.size("members") > 1), lambda x, m: (m["longer"] == 0) | (m["at"] == x["at"]) & (m["word"] > x["word"]))
    return _verified(few.union(split))


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of each row of `forms` (word, form): every step doubles how far a word sees. A form is at least twice as frequent
    as its word, so no chain is longer than 63 and six steps see its end."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(on, "root", "left_semi").isEmpty():
            return now
        now = stage(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spell-roots")


def spelling_groups(words: DataFrame, factor: int = 2, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of `words` (word, n).

    A word's form is its near word of largest n (ties: the smallest in code-point order) if that is `factor` times its own n or more; `root` is the
    end of the chain of forms.
    """
    words = stage(words.select("word", "n"), "spell-words")
    pairs = near_pairs(words, group)
    each = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("other"), F.col("b_n").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("other"), F.col("a_n").alias("other_n")))).alias("e")).select("e.*")
    # one shuffle: what is distinct and what is counted share the word as key; a word's near words are bounded by its length times the alphabet
    each = each.repartition("word").dropDuplicates(["word", "other"])
    best = each.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    best = stage(best.select("word", "n_near", F.when(-F.col("best.less") >= factor * F.col("n"), F.struct(F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("top")), "spell-near")
    roots = _roots(best.filter("top IS NOT NULL").select("word", "top.form"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", F.col("top.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("top.form_n").alias("form_n"))
