"""Chat formatting: a hidden Markov model over lines recovers who speaks, then turns are rendered in one canonical form.

States are the roles. A line emits its speaker marker; a row's first line also emits the row's length class and its
place in the conversation, and the given role, where the table names one, is evidence there and on every marked line. Markers
are strong ("User:", "[assistant]", "### Human", "<|user|>"), fair (names that are also words, before a colon: "Q:",
"Model:") or faint (such names before another sign: "a)", "me |"). Between lines of a row a speaker tends to stay; between
rows, and where a strong marker opens a turn, the change follows a matrix. So a strong marker overrules the given role,
a fair one only speaks where none is given, and a faint one is hardly evidence. A row given as user or assistant never
speaks as system. Lengths, places and changes are counted over all rows with a known role; no model is given from outside.
Viterbi finds the most likely roles twice: from all evidence (`role`) and without the given roles (`text_role`), which
measures the parser where roles are known.

No text is lost: a marker is taken off only where its line opens a part and the decoded role is the marker's, and it stays in
`marker`; the rest is rendered as it stands, with a backslash put into whatever looks like a token of the canonical form
("<|"), so that no text can open or close a turn. `original` undoes this: markers and bodies on end give the row's text.

A conversation is cut into segments of SEGMENT rows, in order of turn, role and text. Where it has several, each segment's
best-path matrix is computed first and a pass over these small matrices fixes the roles at its borders, so the path is that
of the whole conversation while a task holds one segment at a time.

Rows equal in conversation, turn, role and text count once (`copies`). Rows with a null conversation or turn are
conversations of their own. Null texts and empty ones are one blank line. Unknown and null roles are no evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.staging import stage

ROLES = ("system", "user", "assistant")
SEGMENT, LENGTHS, PLACES = 256, 20, 3
#: Names under which speakers appear.
ALIASES = {
    "system": ("system", "sys", "instruction", "instructions"),
    "user": ("user", "human", "me", "customer", "client", "question", "q", "prompter", "you"),
    "assistant": ("assistant", "ai", "bot", "gpt", "model", "agent", "support", "answer", "a", "chatgpt"),
}
#: Those of them that hardly begin a line of prose.
NAMES = ("system", "sys", "user", "human", "prompter", "assistant", "ai", "bot", "gpt", "chatgpt")
_ROLE_OF = {alias: i for i, r in enumerate(ROLES) for alias in ALIASES[r]}
_MARKER = re.compile(
    r"^\s{0,8}(?P<lead>[#>*\[<|(]{0,4}\s?)(?P<name>" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")(?:\s?(?:\d{1,3}))?\s?(?P<sign>[\])>|*]{0,4}\s?[:：]\*{0,2}|[\])>|]{1,4}|(?=\s*$)(?<=[a-z]))\s?", re.I
)
FAINT, FAIR, STRONG = range(3)
#: Log-probabilities of a marker where its role speaks and where another does, by strength.
_HIT, _MISS = (math.log(0.5), math.log(0.8), math.log(0.95)), (math.log(0.25), math.log(0.1), math.log(0.025))
#: Of the given role and each other one: on a row's first line, and on a marked line.
_GIVEN, _NOT_GIVEN = (math.log(0.99), math.log(0.9)), (math.log(0.005), math.log(0.05))
_NEVER = -1e3
_STAY, _LEAVE = math.log(0.98), math.log(0.01)
_N = len(ROLES)


def canonical_role(role: F.Column) -> F.Column:
    """The number of a role by any of its names; null if unknown."""
    name = F.lower(F.trim(role))
    out = F.lit(None).cast("int")
    for i, r in enumerate(ROLES):
        out = F.when(name.isin(list(ALIASES[r])), F.lit(i)).otherwise(out)
    return out


def prepare(turns: DataFrame) -> DataFrame:
    """conv_id, turn, given_role, text, copies, conv (key), given, id (rises in the sort order), seg.

    Ranges of the sort order are numbered side by side; a conversation's rows in earlier ranges, one count a range, are
    added. Ranges are cut by the first letters of texts, so the driver's sample holds no whole ones.
    """
    t = turns.select("conv_id", "turn", F.col("role").alias("given_role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.groupBy("conv_id", "turn", "given_role", "text").agg(F.count(F.lit(1)).alias("copies"))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    own = F.concat(F.lit("-"), F.xxhash64("conv_id", "turn", "given_role", "text").cast("string"))
    t = t.withColumn("conv", F.when(alone, own).otherwise(F.concat(F.lit("+"), F.col("conv_id").cast("string"))))
    t = t.withColumn("given", canonical_role(F.col("given_role")))
    t = t.repartitionByRange("conv", "turn", "given_role", F.substring("text", 1, 200)).sortWithinPartitions("conv", "turn", "given_role", "text")
    t = stage(t.withColumn("id", F.monotonically_increasing_id()), "chat-rows").withColumn("range", F.shiftright("id", 33))
    parts = t.groupBy("conv", "range").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("conv").orderBy("range")) - F.col("n")
    parts = parts.select("conv", "range", (F.col("low") - ahead).alias("zero"))
    return t.join(parts, ["conv", "range"]).withColumn("seg", F.floor((F.col("id") - F.col("zero")) / SEGMENT).cast("long")).drop("range", "zero")


def _length(text: F.Column) -> F.Column:
    return F.least(F.floor(F.log2(F.length(text) + 1) * 2), F.lit(LENGTHS - 1)).cast("int")


def _place(turn: F.Column) -> F.Column:
    return F.greatest(F.least(F.coalesce(turn.cast("long"), F.lit(0)), F.lit(PLACES - 1)), F.lit(0)).cast("int")


def learn(rows: DataFrame) -> dict[str, list]:
    """Log-probabilities of length class, place and change of role, counted over every row with a known role.

    Two small tables of fixed size reach the driver.
    """
    order = Window.partitionBy("conv", "seg").orderBy("id")
    known = rows.withColumn("before", F.lag("given").over(order)).filter("given IS NOT NULL")
    counts = known.groupBy("given", "before", _length(F.col("text")).alias("length"), _place(F.col("turn")).alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()
    # changes between the last row of a segment and the first of the next
    ends = rows.groupBy("conv", "seg").agg(F.min_by("given", "id").alias("given"), F.max_by("given", "id").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("conv").orderBy("seg"))).filter("before IS NOT NULL AND given IS NOT NULL")
    crossings = ends.groupBy("given", "before").agg(F.count(F.lit(1)).alias("n")).collect()
    length, place, change = np.ones((_N, LENGTHS)), np.ones((_N, PLACES)), np.ones((_N, _N))
    for r in counts:
        length[r["given"], r["length"]] += r["n"]
        place[r["given"], r["place"]] += r["n"]
        if r["before"] is not None:
            change[r["before"], r["given"]] += r["n"]
    for r in crossings:
        change[r["before"], r["given"]] += r["n"]
    log = lambda m: np.log(m / m.sum(1, keepdims=True)).tolist()
    within = np.where(np.eye(_N) > 0, _STAY, _LEAVE)
    either = np.log((np.exp(within) + np.exp(np.array(log(change)))) / 2).tolist()
    # the change of role at a marked line by the marker's strength: as within a row, either, as between rows
    return {"length": log(length), "place": log(place), "change": log(change), "marked": [within.tolist(), either, log(change)]}


def marker_of(line: str) -> tuple[int, int, int] | None:
    """(role, strength, characters) of the marker that a line begins with."""
    m = _MARKER.match(line)
    if not m:
        return None
    name, lead, sign = m["name"].lower(), m["lead"].strip(), m["sign"]
    colon = ":" in sign or "：" in sign
    if not sign and lead[:1] != "#":
        return None
    framed = lead[:1] == "#" or lead[:2] == "<|" and sign[:2] == "|>" or lead[:1] == "[" and "]" in sign
    strength = STRONG if framed and (name in NAMES or lead[:2] == "<|") or colon and name in NAMES else FAIR if colon or framed else FAINT
    return _ROLE_OF[name], strength, m.end()


def lines_of(text: str) -> list[tuple[tuple[int, int, int] | None, str]]:
    """(marker or None, line) of each line."""
    return [(marker_of(line), line) for line in text.split("\n")]


_WITHIN = [[_STAY if i == j else _LEAVE for j in range(_N)] for i in range(_N)]


def steps_of(row: dict, lines: list, model: dict[str, list], with_given: bool) -> list[tuple[list, list[float]]]:
    """(change matrix, emissions) of each line of a row."""
    text, given = row["text"], row["given"] if with_given else None
    size = min(int(math.log2(len(text) + 1) * 2), LENGTHS - 1)
    place = max(min(row["turn"] or 0, PLACES - 1), 0)
    out = []
    for k, (marker, _) in enumerate(lines):
        e = [model["length"][s][size] + model["place"][s][place] for s in range(_N)] if k == 0 else [0.0] * _N
        change = model["change"] if k == 0 else _WITHIN
        if marker is not None:
            role, strength, _ = marker
            e = [x + (_HIT if s == role else _MISS)[strength] for s, x in enumerate(e)]
            change = change if k == 0 else model["marked"][strength]
        if given is not None and (k == 0 or marker is not None):
            marked = int(marker is not None and (k > 0 or marker[1] == STRONG))
            e = [x + (_GIVEN if s == given else _NOT_GIVEN)[marked] for s, x in enumerate(e)]
        if given:
            e[0] += _NEVER
        out.append((change, e))
    return out


def parts_of(lines: list, roles: list[int]) -> list[tuple[int, str, str]]:
    """(first line, marker, body) of each part of a row: one opens at its start, where the role changes, and at a strong
    marker of the role that speaks."""
    out: list[tuple[int, str, list[str]]] = []
    for k, ((marker, line), role) in enumerate(zip(lines, roles)):
        own = marker is not None and marker[0] == role and marker[1] > FAINT
        if k == 0 or role != roles[k - 1] or own and marker[1] == STRONG:
            cut = marker[2] if own else 0
            out.append((k, line[:cut], [line[cut:]]))
        else:
            out[-1][2].append(line)
    return [(k, marker, "\n".join(body)) for k, marker, body in out]


def viterbi(steps: list, before: int | None = None, last: int | None = None) -> list[int]:
    """The best path of roles; `before` is the role ahead of the first line, `last` the one of the final line, if fixed."""
    (change, e), back = steps[0], []
    score = [x + (change[before][s] if before is not None else 0.0) for s, x in enumerate(e)]
    for change, e in steps[1:]:
        best = [max(range(_N), key=lambda p: score[p] + change[p][s]) for s in range(_N)]  # noqa: B023
        score = [score[best[s]] + change[best[s]][s] + e[s] for s in range(_N)]
        back.append(best)
    at = last if last is not None else max(range(_N), key=score.__getitem__)
    path = [at]
    for best in reversed(back):
        at = best[at]
        path.append(at)
    return path[::-1]


def best_paths(steps: list, first: bool) -> list[list[float]]:
    """Best score from each role ahead of a segment to each role of its last line; row 0 alone where it is the first."""
    out = []
    for before in range(_N):
        change, e = steps[0]
        score = [x + (0.0 if first else change[before][s]) for s, x in enumerate(e)]
        for change, e in steps[1:]:
            score = [max(score[p] + change[p][s] for p in range(_N)) + e[s] for s in range(_N)]
        out.append(score)
    return out


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows of one segment at a time, from sorted rows."""
    at, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["conv"], row["seg"]) != at:
                if held:
                    yield held
                at, held = (row["conv"], row["seg"]), []
            held.append(row)
    if held:
        yield held


_SORT = ("conv", "seg", "turn", "given_role", "text")
_BORDERS = "conv string, seg long, before int, last int, text_before int, text_last int"


def borders(rows: DataFrame, model: dict[str, list]) -> DataFrame:
    """Roles ahead of and at the end of each segment, for conversations of several segments."""
    several = rows.groupBy("conv").agg(F.min("seg").alias("first_seg"), F.max("seg").alias("last_seg")).filter("first_seg < last_seg")
    wide = rows.join(several, "conv").repartition("conv", "seg").sortWithinPartitions(*_SORT)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _segments(batches):
            split = [lines_of(r["text"]) for r in held]
            m = [[x for line in best_paths([s for r, l in zip(held, split) for s in steps_of(r, l, model, g)], held[0]["seg"] == held[0]["first_seg"]) for x in line] for g in (True, False)]
            yield pa.RecordBatch.from_pylist([{"conv": held[0]["conv"], "seg": held[0]["seg"], "m": m[0], "t": m[1]}])

    def link(pdf):
        pdf = pdf.sort_values("seg").reset_index(drop=True)
        for name, col in (("", "m"), ("text_", "t")):
            ms = np.stack([np.array(x).reshape(_N, _N) for x in pdf[col]])
            score, back = ms[0][0], []
            for m in ms[1:]:
                total = score[:, None] + m
                back.append(total.argmax(0))
                score = total.max(0)
            path = [int(score.argmax())]
            for b in reversed(back):
                path.append(int(b[path[-1]]))
            path = path[::-1]
            pdf[f"{name}last"] = path
            pdf[f"{name}before"] = [None, *path[:-1]]
        pdf = pdf.astype({"before": "Int32", "text_before": "Int32"})
        return pdf[["conv", "seg", "before", "last", "text_before", "text_last"]]

    return wide.mapInArrow(matrices, "conv string, seg long, m array<double>, t array<double>").groupBy("conv").applyInPandas(link, _BORDERS)


def render(role: str, text: str) -> str:
    """The canonical form of a turn; what looks like a token in the text gets one backslash more."""
    return f"<|{role}|>\n" + re.sub(r"<(\\*)\|", r"<\\\1|", text) + "\n<|end|>\n"


def original(rendered: str) -> tuple[str, str]:
    """(role, text) of a canonical turn."""
    head, _, rest = rendered.partition("\n")
    return head[2:-2], re.sub(r"<\\(\\*)\|", r"<\1|", rest.removesuffix("\n<|end|>\n"))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, turn, part, copies, given_role, role, text_role, marker, rendered: the turns of every row of `turns`.

    A row whose lines change speaker, or carry a new marker, becomes several parts, numbered from 0.
    """
    rows = prepare(turns)
    model = learn(rows)
    fixed = stage(borders(rows, model), "chat-borders")
    dealt = rows.join(fixed, ["conv", "seg"], "left").repartition("conv", "seg").sortWithinPartitions(*_SORT)
    kinds = {f.name: f.dataType for f in turns.schema.fields}
    out = f"conv_id {kinds['conv_id'].simpleString()}, turn {kinds['turn'].simpleString()}, part int, copies long, given_role string, role string, text_role string, marker string, rendered string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for held in _segments(batches):
            split = [lines_of(r["text"]) for r in held]
            edge = held[0]
            role, text_role = (
                viterbi([s for r, l in zip(held, split) for s in steps_of(r, l, model, g)], edge[f"{n}before"], edge[f"{n}last"]) for g, n in ((True, ""), (False, "text_"))
            )
            found, at = [], 0
            for r, lines in zip(held, split):
                for part, (k, marker, body) in enumerate(parts_of(lines, role[at : at + len(lines)])):
                    name = ROLES[role[at + k]]
                    found.append((r["conv_id"], r["turn"], part, r["copies"], r["given_role"], name, ROLES[text_role[at + k]], marker, render(name, body)))
                at += len(lines)
            schema = schema or ["conv_id", "turn", "part", "copies", "given_role", "role", "text_role", "marker", "rendered"]
            types = (None, None, pa.int32(), pa.int64(), *[pa.string()] * 5)
            arrays = [pa.array(c, t or source) for c, t, source in zip(zip(*found), types, (id_type, turn_type, *[None] * 7))]
            yield pa.RecordBatch.from_arrays(arrays, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type, turn_type = to_arrow_type(kinds["conv_id"]), to_arrow_type(kinds["turn"])
    return dealt.select("conv_id", "turn", "copies", "given_role", "given", "text", "conv", "seg", "before", "last", "text_before", "text_last").mapInArrow(run, out)
