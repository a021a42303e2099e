"""Column expressions on whole texts that several operators share; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that ends a word, as a list of characters and as a Java character class.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for a null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.size(F.split(trimmed, SPACE_CLASS + "+"))).otherwise(F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once a row, also when the body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with as many underscores behind it as it takes for `df` to have no such column (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


NO_SPANS = "array<struct<kind:int,start:int,end:int,hit:string,before:string>>"
#: Elements in a block of a running total, and characters in a piece of a text that is cut up.
_BLOCK, _PIECE = 128, 1024


def running(values: Column, op) -> Column:
    """The running `op` (an associative function of two columns) of an array, block by block: an array that grows by
    one element is copied each time, so it is never longer than a block, or than there are blocks."""
    last = lambda a: F.element_at(a, F.lit(-1))

    def grow(rows: Column, value) -> Column:
        """The running `op` of value(row) over a short array; the first row is the start."""
        start = F.array(value(F.get(rows, F.lit(0))))
        return F.aggregate(F.slice(rows, F.lit(2), F.size(rows)), start, lambda acc, x: F.array_append(acc, op(last(acc), value(x))))

    def blocks(v: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / _BLOCK).cast("int")), lambda j: F.slice(v, j * _BLOCK + 1, F.lit(_BLOCK)))
        return F.transform(cut, lambda block: grow(block, lambda x: x))

    def joined(parts: Column) -> Column:
        ahead = lambda heads: F.flatten(F.transform(parts, lambda p, j: F.when(j == 0, p).otherwise(F.transform(p, lambda x: op(F.get(heads, j - 1), x)))))
        return F.when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(let(grow(parts, last), ahead))

    return let(values, lambda v: F.when(F.size(v) == 0, v).otherwise(let(blocks(v), joined)))


def match_spans(text: Column, pattern: str, kind: int = 0, keep=None, gate: str | None = None, context: int = 0) -> Column:
    """Array of (kind, start, end, hit, before) of the leftmost non-overlapping matches, in code points, end exclusive.

    The pattern must not match the empty string. The gaps between matches come from `split`, the matches from
    `regexp_extract_all`; running sums of their lengths are the positions, so the time is proportional to the text's
    length, however many matches it has. `before` holds the last `context` characters ahead of a match, no further back
    than the start of the match before it. `keep(hit)` drops matches that fail it. Texts that do not match `gate`
    (the pattern itself, if not given) cost one scan and nothing more.
    """

    def place(both: Column) -> Column:
        gaps, hits = both["gaps"], both["hits"]
        ends = running(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)), lambda a, b: a + b)

        def before(i: Column) -> Column:
            return F.right(F.concat(F.when(i > 0, F.right(F.get(hits, i - 1), F.lit(context))).otherwise(""), F.right(F.get(gaps, i), F.lit(context))), F.lit(context))

        def span(end: Column, i: Column) -> Column:
            hit = F.get(hits, i)
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"), hit.alias("hit"), (before(i) if context else F.lit("")).alias("before"))

        spans = F.transform(ends, span)
        return spans if keep is None else F.filter(spans, lambda s: keep(s["hit"]))

    none = F.array().cast(NO_SPANS)
    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    sure = let(both, lambda b: F.when(F.size(b["hits"]) > 0, place(b)).otherwise(none)) if gate else let(both, place)
    return F.when(F.rlike(text, F.lit(gate or pattern)), F.coalesce(sure, none)).otherwise(none)


def apart(extra: Column, base: Column) -> Column:
    """The spans of `extra` that meet none of `base` (both with start and end), by running maxima and minima."""
    one = lambda s, own: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(own).alias("own"), s.alias("span"))
    every = F.array_sort(F.concat(F.transform(base, lambda s: one(s, 0)), F.transform(extra, lambda s: one(s, 1))))
    far = (1 << 31) - 1

    def pick(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda s: F.when(s["own"] == 0, s["end"]).otherwise(F.lit(-1))), F.greatest)
        after = F.reverse(running(F.reverse(F.transform(rows, lambda s: F.when(s["own"] == 0, s["start"]).otherwise(F.lit(far)))), F.least))
        edges = F.struct(reach.alias("reach"), after.alias("after"))
        free = lambda e: F.filter(rows, lambda s, i: (s["own"] == 1) & (F.get(e["reach"], i) <= s["start"]) & (F.get(e["after"], i) >= s["end"]))
        return F.transform(let(edges, free), lambda s: s["span"])

    return F.when((F.size(extra) == 0) | (F.size(base) == 0), extra).otherwise(let(every, pick))


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each of `spans` (start, end; sorted) replaced by mark(span); of spans that overlap only the first
    has a mark, in the place of them all. Characters are taken from short pieces of the text, never counted from its head."""

    def cut(pieces: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / _PIECE).cast("int"), F.floor(b / _PIECE).cast("int")
        piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
        head = F.substring(piece(i), (a - i * _PIECE + 1).cast("int"), F.lit(_PIECE))
        tail = F.left(piece(j), (b - j * _PIECE).cast("int"))
        whole = F.concat(head, F.array_join(F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), tail)
        return F.when(a >= b, F.lit("")).when(i == j, F.substring(piece(i), (a - i * _PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise(whole)

    def build(p: Column) -> Column:
        reach, pieces = p["reach"], p["pieces"]
        at = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(F.lit(0))
        part = lambda s, i: F.when(s["start"] >= at(i), F.concat(cut(pieces, at(i), s["start"]), mark(s))).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(p["spans"], part), ""), cut(pieces, F.element_at(reach, F.lit(-1)), F.length(text)))

    def parts(x: Column) -> Column:
        ends = running(F.transform(x, lambda s: s["end"].cast("int")), F.greatest)
        return F.struct(x.alias("spans"), ends.alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0)).alias("pieces"))

    return let(spans, lambda x: F.when(F.size(x) > 0, let(parts(x), build)).otherwise(text))


def span_string(spans: Column, names: tuple[str, ...], by_kind: bool) -> Column:
    """kind:start:end of all spans, comma-joined, ordered by kind and start, or by start and kind."""
    first, second = ("kind", "start") if by_kind else ("start", "kind")
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["end"].alias("end"))))
    kinds = F.array(*[F.lit(n) for n in names])

    def show(s: Column) -> Column:
        kind, start = (s["a"], s["b"]) if by_kind else (s["b"], s["a"])
        return F.concat_ws(":", F.get(kinds, kind), start.cast("string"), s["end"].cast("string"))

    return F.array_join(F.transform(ordered, show), ",")
