"""Lines under a state: fences, comments and code spans as an associative fold over stretches of lines, and what a block of lines is exempt from.

A line changes the state by one of finitely many maps from four states to four: prose, inside a fence of backticks, inside one of tildes, inside a
comment. Maps compose, and composition is associative, so a stretch of lines is one map of eight bits, whoever computes it and in which order; with
the maps before it, each stretch knows the state in which it begins, and stretches of one long text are read by different tasks.

A null text has no lines; a text's last line needs no line end; an open fence or comment lasts to the end of its text.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import let

PROSE, BACKTICKS, TILDES, COMMENT = range(4)
#: The map that changes nothing: two bits for each state, the lowest for prose.
UNCHANGED = PROSE | BACKTICKS << 2 | TILDES << 4 | COMMENT << 6
_CLOSED = r"(?s)<!(?=--).*?-->"
_TURNS = "```|~~~|<!--|-->"


def lines_of(text: Column) -> Column:
    """Lines without their ends, as an array; what follows the last end is a line if it is not empty."""
    parts = F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def line_map(line: Column) -> Column:
    """The map of one line, in eight bits."""
    fence = F.when(line.rlike(r"^\s*```"), BACKTICKS).when(line.rlike(r"^\s*~~~"), TILDES).otherwise(PROSE)
    opens = lambda x: F.contains(F.regexp_replace(x, _CLOSED, ""), F.lit("<!--"))
    stays = ~F.contains(line, F.lit("-->")) | opens(F.regexp_replace(line, r"(?s)^.*?-->", ""))
    at = lambda state, value: F.call_function("shiftleft", value, F.lit(2 * state))
    to = [
        F.when(fence != PROSE, fence).when(opens(line), COMMENT).otherwise(PROSE),
        F.when(fence == BACKTICKS, PROSE).otherwise(BACKTICKS),
        F.when(fence == TILDES, PROSE).otherwise(TILDES),
        F.when(stays, COMMENT).otherwise(PROSE),
    ]
    code = at(0, to[0])
    for state in (1, 2, 3):
        code = code.bitwiseOR(at(state, to[state]))
    return code


def after(code: Column, state: Column) -> Column:
    """The state to which a map leads."""
    return F.call_function("shiftright", code, state * 2).bitwiseAND(3)


def then(first: Column, second: Column) -> Column:
    """One map for two in a row."""
    out = F.lit(0)
    for state in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", after(second, after(first, F.lit(state))), F.lit(2 * state)))
    return out


def stretch_map(lines: Column) -> Column:
    """The map of an array of lines; lines that turn no state are skipped."""
    turning = F.filter(lines, lambda x: x.rlike(_TURNS))
    return F.aggregate(F.transform(turning, line_map), F.lit(UNCHANGED), then)


def stretches(texts: DataFrame, keys: list[str], text: str, width: int = 2048) -> DataFrame:
    """(keys, first, state, lines): texts as stretches of at most `width` lines, each with the number of its first line (from 1) and the state in which it begins.

    Maps are composed inside the row, so nothing is shuffled; what comes out can be dealt to any task.
    """
    whole = texts.select(*keys, lines_of(F.col(text)).alias("all"))
    starts = F.when(F.size("all") > 0, F.sequence(F.lit(1), F.size("all"), F.lit(width))).otherwise(F.array().cast("array<int>"))
    cut = whole.select(*keys, F.transform(starts, lambda s: F.struct(s.alias("first"), F.slice("all", s, F.lit(width)).alias("lines"))).alias("parts"))
    begun = F.aggregate(
        F.slice("parts", F.lit(1), F.greatest(F.size("parts") - 1, F.lit(0))),
        F.array(F.lit(PROSE)),
        lambda states, p: F.concat(states, F.array(after(stretch_map(p["lines"]), F.element_at(states, -1)))),
    )
    rows = cut.select(*keys, F.explode(F.arrays_zip("parts", F.slice(begun, F.lit(1), F.size("parts")).alias("states"))).alias("x"))
    return rows.select(*keys, F.col("x.parts.first").cast("bigint").alias("first"), F.col("x.states").alias("state"), F.col("x.parts.lines").alias("lines"))


def entered(parts: DataFrame, keys: list[str], order: str, lines: str) -> DataFrame:
    """(keys, order, state): the state in which each row of a table of stretches begins, where a text is stored as many rows.

    Only maps are shuffled, a byte for a row; a text's maps are one list.
    """
    maps = parts.select(*keys, order, stretch_map(F.col(lines)).alias("code"))
    listed = maps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "code"))).alias("m"))
    begun = F.aggregate("m", F.array(F.lit(PROSE)), lambda states, p: F.concat(states, F.array(after(p["code"], F.element_at(states, -1)))))
    rows = listed.select(*keys, F.explode(F.arrays_zip("m", F.slice(begun, F.lit(1), F.size("m")).alias("s"))).alias("x"))
    return rows.select(*keys, F.col(f"x.m.{order}").alias(order), F.col("x.s").alias("state"))


def comment_spans(line: str, inside: bool) -> tuple[list[tuple[int, int]], bool]:
    """Where a line is comment, and whether its end is."""
    spans, at = [], 0
    while True:
        if not inside:
            at = line.find("<!--", at)
            if at < 0:
                return spans, False
        end = line.find("-->", at)
        if end < 0:
            spans.append((at, len(line)))
            return spans, True
        spans.append((at, end + 3))
        at, inside = end + 3, False


def code_spans(line: str) -> list[tuple[int, int]]:
    """Runs of backticks, each closed by the next run of its length; one that nothing closes is text."""
    runs = [m.span() for m in re.finditer("`+", line)]
    later: dict[int, list[int]] = {}
    for i, (a, b) in enumerate(runs):
        later.setdefault(b - a, []).append(i)
    spans, i = [], 0
    for same in later.values():
        same.reverse()
    while i < len(runs):
        a, b = runs[i]
        same = later[b - a]
        while same and same[-1] <= i:
            same.pop()
        if same:
            spans.append((a, runs[same[-1]][1]))
            i = same[-1]
        i += 1
    return spans


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a < b:
            out.append((a, b))
    return out


_MASKED = (("line", T.LongType()), ("fenced", T.BooleanType()), ("comment", T.LongType()), ("code", T.LongType()), ("visible", T.StringType()))


def masked_lines(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line, fenced, comment, code, visible) for every line of `stretches`: whether it is a fence or inside one, how many of its characters are
    comment, how many are code and no comment, and what is left of it, with blanks in place of both. A fenced line shows nothing."""
    schema = T.StructType([parts.schema[k] for k in keys] + [T.StructField(n, t) for n, t in _MASKED])

    def run(batches):
        for batch in batches:
            row, line_no, fenced, comment, code, visible = [], [], [], [], [], []
            for r, (first, state, lines) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("first", "state", "lines")))):
                for i, line in enumerate(lines):
                    row.append(r)
                    line_no.append(first + i)
                    mark = line.lstrip()[:3]
                    fence = BACKTICKS if mark == "```" else TILDES if mark == "~~~" else PROSE
                    if state != COMMENT and (fence or state):
                        state = fence if state == PROSE else PROSE if state == fence else state
                        for out, value in ((fenced, True), (comment, 0), (code, 0), (visible, "")):
                            out.append(value)
                        continue
                    hidden, inside = comment_spans(line, state == COMMENT)
                    state = COMMENT if inside else PROSE
                    masked = _covered(hidden + code_spans(line)) if "`" in line else hidden
                    left = line
                    for a, b in masked:
                        left = left[:a] + " " * (b - a) + left[b:]
                    n = sum(b - a for a, b in hidden)
                    for out, value in ((fenced, False), (comment, n), (code, sum(b - a for a, b in masked) - n), (visible, left)):
                        out.append(value)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(k).take(at) for k in keys] + [pa.array(line_no, pa.int64()), pa.array(fenced, pa.bool_()), pa.array(comment, pa.int64()), pa.array(code, pa.int64()), pa.array(visible, pa.string())],
                names=schema.names,
            )

    return parts.select(*keys, "first", "state", "lines").mapInArrow(run, schema)


# Marks of a licence header, the lines up to which it may begin, beginnings of lines that are a form and no prose, the longest line of prose.
HEADER_MARKS = (
    "SPDX-License-Identifier",
    "Licensed under the Apache License",
    "Copyright (c)",
    "Permission is hereby granted",
    "MIT License",
)
HEADER_LINES, LINE_CAP = 5, 200
FORM_PREFIXES = (
    "Args:", "Arguments:", "Returns:", "Raises:", "Yields:", "Parameters", "Attributes:", "Example:",
    "Examples:", "Note:", ":param ", ":return", ":rtype", "@param", "@returns", "@throws",
)
ALLOW_MARK = "allow(duplicate)"
FENCE_LINE = r"^\s*[#/*! ]*(```|~~~)"
FORM_LINE = r"""^\s*[#/*!"' ]*(-{3,}\s*$|""" + "|".join(FORM_PREFIXES) + ")"


def blocks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block, start, body): runs of lines that are not blank, numbered from 0, with the number of the first one's first line (null for later ones)."""
    t = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n", "\n")
    lead = F.regexp_extract(t, r"\A(\s*\n)?", 1)
    rows = texts.select(key, t.alias("t"), (F.length(lead) - F.length(F.replace(lead, F.lit("\n"), F.lit(""))) + 1).alias("start"), F.length(lead).alias("skip"))
    parts = F.split(F.expr("substring(t, skip + 1)"), r"\n\s*\n|\n\s*\z", -1)
    out = rows.select(key, "start", F.posexplode(parts).alias("block", "body")).where(F.col("body").rlike(r"\S"))
    return out.select(key, F.col("block").cast("bigint").alias("block"), F.when(F.col("block") == 0, F.col("start")).cast("bigint").alias("start"), "body")


def exemption(block: Column, start: Column, body: Column, mark: str = ALLOW_MARK) -> Column:
    """Why a block is not judged: 'license_header' for a first block near the top with a header's mark, 'inline_allow' where the allow mark gives a reason
    after `--`. A mark without a reason exempts nothing: 'allow_missing_why'. All others are 'live'."""
    header = F.lit(False)
    for m in HEADER_MARKS:
        header = header | F.contains(body, F.lit(m))
    reason = re.escape(mark).replace("/", r"\/") + r"[^\n]*?--[^\n]*\S"
    return (
        F.when((block == 0) & (start <= HEADER_LINES) & header, "license_header")
        .when(body.rlike(reason), "inline_allow")
        .when(F.contains(body, F.lit(mark)), "allow_missing_why")
        .otherwise("live")
    )


def stripped(body: Column) -> Column:
    """(kept, fenced_code, form, overlong): lines of a block that stay, and how many go as fenced code (fences of either kind toggle, an open one lasts to the
    block's end), as lines of a form and as lines of more than LINE_CAP characters, asked in this order."""
    outside = F.regexp_replace(body, rf"(?ms){FENCE_LINE}[^\n]*(?:\n.*?{FENCE_LINE}[^\n]*|.*\z)(?:\n|\z)", "")
    ask = lambda x: F.when(x.rlike(FORM_LINE), 1).when(F.length(F.trim(x)) > LINE_CAP, 2).otherwise(0)
    left = let(F.when(outside == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(outside, r"\n\z", ""), "\n", -1)), lambda p: F.transform(p, lambda x: F.struct(x.alias("line"), ask(x).alias("k"))))
    count = lambda p, k: F.size(F.filter(p, lambda x: x["k"] == k)).cast("bigint")
    return let(
        left,
        lambda p: F.struct(
            F.transform(F.filter(p, lambda x: x["k"] == 0), lambda x: x["line"]).alias("kept"),
            (F.size(F.split(body, "\n", -1)) - F.size(p)).cast("bigint").alias("fenced_code"),
            count(p, 1).alias("form"),
            count(p, 2).alias("overlong"),
        ),
    )
