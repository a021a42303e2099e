"""Note content: canonical form, frontmatter, comparison forms, integrity."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions import paths as P
from tidemark.functions.bind import let

BOM = "﻿"


def sha(content: Column) -> Column:
    return F.sha2(content, 256)


def fold_eol(s: Column) -> Column:
    return F.replace(F.replace(s, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def to_base64(content: Column) -> Column:
    """Bytes as base64 in one line."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def body_bytes(field: Column) -> Column:
    """Bytes of a variant that is base64 text or an array of numbers from 0 to 255; null for anything else."""
    get = lambda to: F.call_function("try_variant_get", field, F.lit("$"), F.lit(to))
    kind, text, numbers = F.call_function("schema_of_variant", field), get("string"), get("array<bigint>")
    hexed = F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), 2, "0")), "")
    right = F.forall(numbers, lambda x: F.coalesce(x.between(0, 255), F.lit(False))) & kind.isin("ARRAY<BIGINT>", "ARRAY<VOID>")
    return F.when(kind == "STRING", F.call_function("try_to_binary", text, F.lit("base64"))).when(right, F.unhex(hexed))


def pre_journal(path: Column, body: Column, form: Column, last_hash: Column, allowed: Sequence[str] = (".md",), rules: Sequence[tuple[str, str, str]] = (), managed: bool = True) -> Column:
    """Why a change is not queued: substrate, managed, extension, empty or identical (`form`, the note as it would be pushed, has the server's last hash); null if it is."""
    own = P.is_managed_artifact(path) & F.lit(managed)
    return (
        F.when(P.substrate_rule(path, rules).isNotNull(), "substrate").when(own, "managed").when(~P.allowed_suffix(path, allowed), "extension")
        .when(F.octet_length(body) == 0, "empty").when(F.sha2(form, 256) == last_hash, "identical")
    )


def canonical_form(content: Column) -> Column:
    """(text, error): all leading BOMs off, CRLF and CR to LF; bytes that are no UTF-8 or hold NUL are errors."""
    s = content.cast("string")
    bad = F.when(~F.is_valid_utf8(s), F.lit("non_utf8")).when(F.contains(s, F.lit("\x00")), F.lit("nul"))
    folded = fold_eol(F.ltrim(s, F.lit(BOM)))
    return F.struct(F.when(bad.isNull(), folded).alias("text"), bad.alias("error"))


def strip_one_bom(s: Column) -> Column:
    return F.when(F.startswith(s, F.lit(BOM)), F.substring(s, 2, 1 << 30)).otherwise(s)


def has_frontmatter(s: Column) -> Column:
    t = strip_one_bom(s)
    return F.startswith(t, F.lit("---\n")) | F.startswith(t, F.lit("---\r\n")) | (t == "---")


def frontmatter(s: Column) -> Column:
    """(inner, body) where a block opens with its first line and closes with a line `---`; null without one.

    `inner` starts at byte 4 as on the push side, so a CRLF opening leaves its newline there.
    """
    closed = "(?s)^---\\r?\\n(?:.*?\\n)??---\\r?\\n"

    def cut(block: Column) -> Column:
        close = F.when(F.endswith(block, F.lit("---\r\n")), F.lit(5)).otherwise(F.lit(4))
        inner = F.substring(block, F.lit(5), F.length(block) - close - 4)
        return F.when(block != "", F.struct(inner.alias("inner"), F.substring(s, F.length(block) + 1, F.length(s)).alias("body")))

    return let(F.when(F.startswith(s, F.lit("---")), F.regexp_extract(s, closed, 0)).otherwise(F.lit("")), cut)


def strip_fields(block: Column, fields: Sequence[str]) -> Column:
    """Top-level `key:` lines of the list and the indented lines below them, dropped; every kept line ends with a newline.

    One search over all lines: its loops never go back, so the time is proportional to the block's length."""
    if not fields:
        return block
    keys = "|".join(f"\\Q{f}\\E" for f in fields)
    drop = f"(?md)^(?:{keys}) *+:[^\\n]*+\\n(?:[ \\t][^\\n]*+\\n)*+"
    less = lambda t, end: F.when(F.endswith(t, F.lit(end)), F.left(t, F.length(t) - 1)).otherwise(t)
    ended = let(less(block, "\n"), lambda t: let(F.replace(t, F.lit("\r\n"), F.lit("\n")), lambda u: F.concat(less(u, "\r"), F.lit("\n"))))
    return F.when(block == "", F.lit("")).otherwise(F.regexp_replace(ended, drop, ""))


def _rebuild(s: Column, fields: Sequence[str]) -> Column:
    def build(t: Column, fm: Column) -> Column:
        ended = let(strip_fields(fm["inner"], fields), lambda x: F.when(F.endswith(x, F.lit("\n")), x).otherwise(F.concat(x, F.lit("\n"))))
        return F.when(fm.isNull(), t).otherwise(F.concat(F.lit("---\n"), ended, F.lit("---\n"), fm["body"]))

    return let(s, lambda t: let(frontmatter(t), lambda fm: build(t, fm)))


def pull_form(s: Column, fields: Sequence[str]) -> Column:
    """Comparison form on the pull side: one BOM off, line ends folded, listed fields dropped."""
    return _rebuild(fold_eol(strip_one_bom(s)), fields)


def push_form(s: Column, fields: Sequence[str]) -> Column:
    """Comparison form on the push side: no BOM or line-end folding."""
    return _rebuild(s, fields)


def body_only(s: Column) -> Column:
    return let(fold_eol(strip_one_bom(s)), lambda t: F.coalesce(frontmatter(t)["body"], t))


def lines(s: Column) -> Column:
    """Lines without their ends; a final newline opens no further line."""
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(s, "\\r?\\n$", ""), "\\r?\\n"))


def contained_in_order(server: Column, local: Column) -> Column:
    """Whether the lines of one text are an ordered part of the other's."""
    want = lines(server)
    return F.aggregate(lines(local), F.lit(0), lambda p, h: F.when(F.get(want, p).eqNullSafe(h), p + 1).otherwise(p)) >= F.size(want)


#: Plain words that a YAML reader takes for null, truth values and the like.
_YAML_WORDS = {"", "~", "null", "true", "false", "yes", "no", "on", "off", "y", "n", "<<", "=", "---", "...", ".inf", "-.inf", "+.inf", ".nan"}
_YAML_PLAIN = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`\x00-\x1f\x7f]([^\x00-\x1f\x7f\x85\u2028\u2029\ufeff]*[^\s:\x00-\x1f\x7f\ufeff])?")


def _yaml_text(v: str) -> str:
    """A string as a YAML scalar that reads as that string."""
    number = v[:1].isdigit() or v[:1] in "+." and len(v) > 1
    if _YAML_PLAIN.fullmatch(v) and v.lower() not in _YAML_WORDS and not number and ": " not in v and " #" not in v and ":\t" not in v:
        return v
    if v.isprintable():
        return "'" + v.replace("'", "''") + "'"
    return json.dumps(v, ensure_ascii=True) if v.isascii() or all(ord(c) < 0x10000 for c in v) else '"' + "".join(c if c.isprintable() and c not in '"\\' else f"\\U{ord(c):08x}" for c in v) + '"'


def _yaml_lines(value, indent: str = "") -> list[str]:
    """Block style: mappings by rising key, lists at the depth of their key."""
    out: list[str] = []
    if isinstance(value, dict):
        for k in sorted(value):
            v, head = value[k], f"{indent}{_yaml_text(k)}:"
            if isinstance(v, (dict, list)) and v:
                out += [head, *_yaml_lines(v, indent + "  " if isinstance(v, dict) else indent)]
            else:
                out.append(f"{head} {_yaml_scalar(v)}")
        return out
    for v in value:
        if isinstance(v, (dict, list)) and v:
            first, *rest = _yaml_lines(v, indent + "  ")
            out += [f"{indent}- {first[len(indent) + 2 :]}", *rest]
        else:
            out.append(f"{indent}- {_yaml_scalar(v)}")
    return out


def _yaml_scalar(v) -> str:
    return _yaml_text(v) if isinstance(v, str) else json.dumps(v)


@F.pandas_udf(StringType())
def _yaml(s: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        value = json.loads(text) if text is not None else None
        if value is None or value == {}:
            return None
        lines = _yaml_lines(value) if isinstance(value, (dict, list)) and value else [_yaml_scalar(value)]
        return "".join(line + "\n" for line in lines)

    return s.map(one)


def with_frontmatter(meta_json: Column, body: Column) -> Column:
    """The body behind its metadata as a YAML block, keys in rising order; without metadata (null or {}) the body alone."""
    block = _yaml(meta_json)
    return F.when(block.isNull(), body).otherwise(F.concat(F.lit("---\n"), block, F.lit("---\n\n"), body))


def byte_check(content: Column, size: Column, digest: Column) -> Column:
    """ok, size_mismatch or sha_mismatch:<16 hex digits>; the hash is not computed where the size differs."""
    b = content.cast("binary")
    actual = F.sha2(b, 256)
    return F.when(F.octet_length(b) != size, F.lit("size_mismatch")).when(actual == F.lower(digest), F.lit("ok")).otherwise(F.concat(F.lit("sha_mismatch:"), F.left(actual, F.lit(16))))


@F.pandas_udf(StringType())
def _syntax(kind: pd.Series, text: pd.Series) -> pd.Series:
    import json
    import tomllib

    try:
        import yaml
    except ImportError:  # without a reader of YAML its files go unchecked
        yaml = None

    def refuse(name: str):
        raise ValueError(name)

    def keys_once(node) -> bool:
        """Whether no mapping has a plain key twice."""
        todo, seen = [node], set()
        while todo:
            n = todo.pop()
            if n is None or id(n) in seen:
                continue
            seen.add(id(n))
            if isinstance(n, yaml.MappingNode):
                keys = [(k.tag, k.value) for k, _ in n.value if isinstance(k, yaml.ScalarNode)]
                if len(keys) != len(set(keys)):
                    return False
                todo += [x for pair in n.value for x in pair]
            elif isinstance(n, yaml.SequenceNode):
                todo += n.value
        return True

    def one(k: str, t: str) -> str:
        try:
            if k == "toml":
                tomllib.loads(t)
            elif k == "json":
                json.loads(t, parse_constant=refuse)
            elif k == "py":
                compile(t, "f", "exec", dont_inherit=True)
            elif yaml:
                parts = list(yaml.compose_all(t, yaml.CSafeLoader if hasattr(yaml, "CSafeLoader") else yaml.SafeLoader))
                if len(parts) > 1 or not all(map(keys_once, parts)):
                    return "invalid"
            else:
                return "skipped"
        except (ValueError, SyntaxError, RecursionError, *((yaml.YAMLError,) if yaml else ())):
            return "invalid"
        return "ok"

    return pd.Series([one(k, t or "") for k, t in zip(kind, text)])


def syntax_check(path: Column, text: Column) -> Column:
    """ok, invalid or skipped by the path's ending. JSON is parsed in the JVM, inside an array that its own digest ends, so that text behind
    the value is seen; what is refused there (a key twice is fine in JSON) is parsed again. TOML, YAML (one document a
    file, no key twice) and Python (compiled, so that a stray return is seen) are parsed in Arrow batches. Files of other endings never leave the JVM."""
    ext = F.lower(F.regexp_extract(path, "[^/]\\.([A-Za-z]+)$", 1))
    mark = F.md5(text.cast("binary"))
    parsed = F.call_function("try_parse_json", F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]')))
    whole = F.coalesce(F.call_function("try_variant_get", parsed, F.lit("$[1]"), F.lit("string")) == mark, F.lit(False))
    kind = F.when(ext.isin("yml", "yaml"), F.lit("yaml")).when(ext.isin("toml", "py") | (ext == "json") & ~whole, ext)
    return F.when((ext == "json") & whole, F.lit("ok")).when(kind.isNotNull(), _syntax(kind, F.when(kind.isNotNull(), text))).otherwise(F.lit("skipped"))


def integrity(path: Column, content: Column, size: Column, digest: Column) -> Column:
    """Bytes first; the syntax is looked at only where they are right."""
    by = byte_check(content, size, digest)
    return F.when(by != "ok", by).otherwise(syntax_check(path, content.cast("string")))
