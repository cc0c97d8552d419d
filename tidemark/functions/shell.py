"""Shell command lines as invocations. Quotes make this a scanner, so it is a table function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ASSIGNMENT = re.compile(r"[A-Za-z_][A-Za-z0-9_]*=")
#: What stands for a wrapped program: the words that may come before its name.
WRAPPERS = {"npx": None, "pnpm": ("exec", "dlx"), "npm": ("exec",), "yarn": ("dlx",)}


class Invocation(NamedTuple):
    binary: str
    subcommand: str | None
    args: str | None
    kind: str
    command: str
    segment: int


# A quoted stretch (to the end if left open), an operator, or other characters.
_SEGMENT = re.compile(r"[^'\";|&>]+|'[^']*(?:'|\Z)|\"[^\"]*(?:\"|\Z)|(?P<keep>>&|&>)|(?P<cut>\|\||&&|[;|&])|.", re.S)


def segments(command: str) -> list[str]:
    """Parts between ; | || & &&, outside of quotes; >& and &> are redirections."""
    parts, current = [], []
    for m in _SEGMENT.finditer(command):
        if m.lastgroup == "cut":
            parts.append("".join(current))
            current = []
        else:
            current.append(m[0])
    parts.append("".join(current))
    return [p.strip() for p in parts if p.strip()]


_TOKEN = re.compile(r"(?:'[^']*(?:'|\Z)|\"(?:\\.|[^\"\\])*(?:\"|\Z)|\\.|[^\s'\"\\]|\\\Z)+", re.S)
_PIECE = re.compile(r"'([^']*)(?:'|\Z)|\"((?:\\.|[^\"\\])*)(?:\"|\Z)|\\(.)|([^'\"\\]+)", re.S)


def tokens(segment: str) -> list[str]:
    """Words with quotes and escapes taken off; empty words are dropped."""
    out = []
    for m in _TOKEN.finditer(segment):
        word = "".join(a or re.sub(r"(?s)\\(.)", r"\1", b or "") or c or d or "" for a, b, c, d in _PIECE.findall(m[0]))
        if word:
            out.append(word)
    return out


def _skip(words: list[str], at: int, test) -> int:
    while at < len(words) and test(words[at]):
        at += 1
    return at


def unwrapped(words: list[str]) -> list[str]:
    """Without sudo and its options, env and its settings, `command`, and assignments."""
    if words and words[0].lower() == "sudo":
        words = words[_skip(words, 1, lambda w: w.startswith("-")) :]
    if words and words[0].lower() == "env":
        words = words[_skip(words, 1, lambda w: "=" in w) :]
    if words and words[0].lower() == "command":
        words = words[1:]
    return words[_skip(words, 0, lambda w: bool(ASSIGNMENT.match(w))) :]


def binary(word: str) -> str:
    base = word.rstrip("/").rpartition("/")[2].lower() or ("/" if word.startswith("/") else "")
    return "" if base.startswith("-") else base


def parse(words: list[str], cargo_binaries: dict[str, str]) -> tuple[str, list[str], str] | None:
    """(binary, its arguments, kind)."""
    if len(words) >= 3 and binary(words[0]) == "cargo" and words[1] == "run" and "--" in words[2:]:
        end = words.index("--", 2)
        named = [words[i + 1] for i in range(2, end - 1) if words[i] in ("-p", "--package")]
        if named and named[-1] in cargo_binaries:
            return cargo_binaries[named[-1]], words[end + 1 :], "cargo_run"
    first = binary(words[0])
    if first in WRAPPERS:
        dash = lambda w: w.startswith("-")
        at, verbs = _skip(words, 1, dash), WRAPPERS[first]
        if verbs is not None:
            at = _skip(words, at + 1, dash) if at < len(words) and words[at] in verbs else len(words)
        if at < len(words) and binary(words[at]):
            return binary(words[at]), words[at + 1 :], f"wrapper:{first}"
    return (first, words[1:], "direct") if first else None


@lru_cache(1 << 16)
def _parsed(segment: str) -> tuple[str, list[str], str] | None:
    words = unwrapped(tokens(segment))
    return parse(words, {}) if words else None


def invocations(command: str, cargo_binaries: dict[str, str] | None = None) -> Iterator[Invocation]:
    for i, segment in enumerate(segments(command)):
        if cargo_binaries:
            words = unwrapped(tokens(segment))
            found = parse(words, cargo_binaries) if words else None
        else:
            found = _parsed(segment)  # the same few commands come again and again
        if found:
            name, rest, kind = found
            yield Invocation(name, rest[0] if rest else None, " ".join(rest[1:]) or None, kind, segment, i)


FIELDS = T.StructType([T.StructField(n, T.IntegerType() if n == "segment" else T.StringType()) for n in Invocation._fields])


@F.udtf(returnType="binary string, subcommand string, args string, kind string, command string, segment int")
class ShellInvocations:
    """SELECT ... FROM t, LATERAL shell_invocations(t.command)"""

    def eval(self, command: str):
        if command:
            yield from invocations(command)


def register(spark) -> None:
    spark.udtf.register("shell_invocations", ShellInvocations)


def report(events: DataFrame, members: DataFrame, binaries: list[str] | None = None) -> DataFrame:
    """(episode_id, event_id, position, ts, binary, ...) of the commands that tool sources recorded."""
    own = members.select("episode_id", "event_id", "position").join(events.where(F.col("source_adapter").endswith("_tool") & (F.trim("content") != "")).select("event_id", "ts", F.trim("content").alias("raw_command")), "event_id")
    out = T.StructType([*own.schema.fields, *FIELDS.fields])
    added = to_arrow_schema(FIELDS)

    def run(batches):
        for batch in batches:
            rows, found = [], []
            for i, command in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for one in invocations(command):
                    rows.append(i)
                    found.append(one)
            kept = batch.take(pa.array(rows, pa.int64()))
            cols = zip(*found, strict=True) if found else [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, f.type) for c, f in zip(cols, added, strict=True))], names=out.names)

    found = own.mapInArrow(run, out)
    return found.where(F.col("binary").isin(binaries)) if binaries else found


def summaries(report_: DataFrame) -> DataFrame:
    """(episode_id, commands, subcommands, binaries) in order of position and segment."""
    ordered = F.sort_array(F.collect_list(F.struct("position", "segment", "command", "subcommand", "binary")))
    out = report_.groupBy("episode_id").agg(ordered.alias("i"))
    pick = lambda f: F.filter(F.transform("i", lambda x: x[f]), lambda x: x.isNotNull()).alias(f + ("s" if f != "binary" else ""))
    return out.select("episode_id", pick("command"), pick("subcommand"), pick("binary").alias("binaries"))
