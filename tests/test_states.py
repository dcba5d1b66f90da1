"""Lines under a state, exempt blocks and seams against plain definitions."""

import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.operators import linestates as ls
from sparkloom.operators import seams
from sparkloom.plans import registry

PIECES = ["```", "````", "~~~", "~~~~ x", "  ```py", "<!--", "-->", "<!-->", "<!--->", "a <!-- b --> c", "`x`", "``a`b``", "`open", "word", "", "   ", "é ü", "<!-- `x --> y`", "x --> y <!-- z"]


def plain(text):
    """(fenced, comment, code, visible) of each line, character by character."""
    lines = re.split("\r?\n", text or "")
    if lines[-1] == "":
        lines.pop()
    fence, inside, out = None, False, []
    for line in lines:
        t = line.lstrip()
        mark = next((m for m in "`~" if t.startswith(m * 3)), None)
        if not inside and (mark or fence):
            if mark and fence in (None, mark):
                fence = None if fence else mark
            out.append((True, 0, 0, ""))
            continue
        hidden = [False] * len(line)
        i = 0
        while i < len(line):
            if not inside and line.startswith("<!--", i):
                inside = True
            if inside:
                end = line.find("-->", i)
                stop = len(line) if end < 0 else end + 3
                hidden[i:stop] = [True] * (stop - i)
                inside = end < 0
                i = stop
            else:
                i += 1
        n = sum(hidden)
        runs = [(m.start(), m.end()) for m in re.finditer("`+", line)]
        k = 0
        while k < len(runs):
            close = next((j for j in range(k + 1, len(runs)) if runs[j][1] - runs[j][0] == runs[k][1] - runs[k][0]), None)
            if close is not None:
                for p in range(runs[k][0], runs[close][1]):
                    hidden[p] = True
                k = close
            k += 1
        out.append((False, n, sum(hidden) - n, "".join(" " if h else c for h, c in zip(hidden, line))))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    made = [None, "", "\n", "a", "```\nnever closed", "<!-- a\n```\n-->\n```\nx\n```", "~~~\n```\n~~~\nprose\r\nmore", "`" * 9 + " a " + "`" * 9]
    for _ in range(80):
        made.append("\n".join(" ".join(rng.choices(PIECES, k=rng.randint(1, 3))) for _ in range(rng.randint(1, 40))))
    return list(enumerate(made))


@pytest.mark.parametrize("width", [1, 3, 2048])
def test_masked_lines_equal_a_plain_walk_at_any_width(spark, texts, width):
    df = spark.createDataFrame(texts, "id bigint, text string").withColumn("first", F.col("id")).withColumnRenamed("first", "line ")
    got = ls.masked_lines(ls.stretches(df, ["id"], "text", width), ["id"]).collect()
    want = {(i, n): row for i, text in texts for n, row in enumerate(plain(text), 1)}
    assert {(r.id, r.line): (r.fenced, r.comment, r.code, r.visible) for r in got} == want


def test_maps_are_associative_and_stored_stretches_agree(spark, texts):
    df = spark.createDataFrame(texts, "id bigint, text string")
    parts = ls.stretches(df, ["id"], "text", 2)
    states = {(r.id, r.first): r.state for r in parts.collect()}
    stored = ls.entered(parts.repartition(7), ["id"], "first", "lines").collect()
    assert {(r.id, r.first): r.state for r in stored} == states and len(states) > 300
    codes = [r.c for r in parts.select(ls.stretch_map(F.col("lines")).alias("c")).distinct().collect()]
    triples = spark.createDataFrame([(a, b, c) for a in codes[:9] for b in codes[:9] for c in codes[:9]], "a int, b int, c int")
    left, right = ls.then(ls.then(F.col("a"), F.col("b")), F.col("c")), ls.then(F.col("a"), ls.then(F.col("b"), F.col("c")))
    assert triples.where(left != right).isEmpty()


def test_line_states_query(spark, sf):
    rows = registry.QUERIES["line_states"](spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    seen = {r.id: r for r in rows if r.kind == "page"}
    assert any(r.comment for r in seen.values())
    for i, html in pages.items():
        want = plain(html)
        if want:
            r = seen[i]
            assert (r.lines, r.fenced, r.comment, r.code) == (len(want), sum(w[0] for w in want), sum(w[1] for w in want), sum(w[2] for w in want))
            assert r.visible == sum(len(w[3].replace(" ", "")) for w in want)


def test_blocks_and_exemptions(spark):
    allow = ls.ALLOW_MARK
    rows = [
        (1, "\n\n// Copyright (c) x\n// more\n\nprose MIT License", [("license_header", 3), ("live", None)]),
        (2, "\n\n\n\n\nMIT License", [("live", 6)]),
        (3, f"a {allow} -- because\n\nb {allow} --  \n\nc {allow}\n\nd -- why {allow}", [("inline_allow", 1), ("allow_missing_why", None), ("allow_missing_why", None), ("allow_missing_why", None)]),
        (4, None, []),
        (5, "  \n \n", []),
        (6, "mit license\r\n\r\n  SPDX-License-Identifier: MIT  \n \n", [("live", 1), ("live", None)]),
        (7, "x" * 300_000 + "\n\n" * 50_000 + "y", [("live", 1), ("live", None)]),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "id bigint, text string")
    got = ls.blocks(df, "id", "text").select("id", "block", "start", ls.exemption(F.col("block"), F.col("start"), F.col("body")).alias("e")).orderBy("id", "block").collect()
    for i, _, want in rows:
        assert [(r.e, r.start) for r in got if r.id == i] == want


def test_stripped_lines(spark):
    rng = random.Random(2)
    pool = ["```", "// ~~~", "# ```x", "Args:", " * @param x", "---", "# ----", "prose", "x" * 201, " " * 9 + "y" * 200, "say Args: no"]
    bodies = ["\n".join(rng.choices(pool, k=rng.randint(1, 12))) for _ in range(150)]

    def plainly(body):
        kept, n, fenced = [], [0, 0, 0], False
        for line in body.split("\n"):
            opens = line.strip().lstrip("#/*! ").startswith(("```", "~~~"))
            bare = line.strip().lstrip("#/*!\"' ").rstrip()
            if fenced or opens:
                n[0] += 1
                fenced = fenced != opens
            elif (len(bare) >= 3 and set(bare) == {"-"}) or bare.startswith(ls.FORM_PREFIXES):
                n[1] += 1
            elif len(line.strip()) > 200:
                n[2] += 1
            else:
                kept.append(line)
        return kept, *n

    df = spark.createDataFrame(list(enumerate(bodies)), "id bigint, body string").select("id", ls.stripped(F.col("body")).alias("s"))
    for r in df.collect():
        assert (r.s.kept, r.s.fenced_code, r.s.form, r.s.overlong) == plainly(bodies[r.id])


def test_running_sums_over_blocks(spark):
    rng = random.Random(1)
    rows = [(k, rng.randint(-50, 20_000), rng.randint(-5, 9)) for k in (1, 1, 1, 2) for _ in range(400)]
    got = seams.running(spark.createDataFrame(rows, "k bigint, at bigint, v bigint"), "k", "at", "v", block=64).collect()
    assert len(got) == len({r[:2] for r in rows})
    for r in got:
        assert r.total == sum(v for k, at, v in rows if k == r.k and at <= r.at)


def test_split_gains_are_those_of_the_definition(spark):
    rng = random.Random(3)
    units, refs, clones, churn, want = [], [], [], [], {}

    def p(x, s=knobs.SOFT, h=knobs.HARD):
        return 0 if x <= s else knobs.ZONE_MAX * Fraction(x - s, h - s) ** 2 if x <= h else knobs.ZONE_MAX * (1 + 2 * Fraction(x - h, h - s))

    for f in range(40):
        n, end, mine = rng.randint(1, 9), 0, []
        for u in range(n):
            end += rng.randint(1, 300)
            mine.append((u, end))
        pick = lambda k: [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, k))]
        r, c = pick(6), pick(4)
        k = [(s, s + rng.randint(0, 400)) for s in rng.sample(range(end), min(end, rng.randint(0, 3)))]
        units += [(f, u, e) for u, e in mine]
        refs += [(f, a, b) for a, b in r]
        churn += [(f, a, b) for a, b in c]
        clones += [(f, s, e) for s, e in k]
        best = None
        for u, e in mine[:-1]:
            cross = lambda q: sum(min(a, b) <= u < max(a, b) for a, b in q)
            cost = 250 * cross(r) + 150 * cross(c) + 500 * sum(s <= e < t for s, t in k) + 500
            gain = max(0, int(1000 * (p(end) - p(e) - p(end - e)) // 1))
            if best is None or Fraction(gain, cost) >= Fraction(best[1], best[2]):
                best = (u, gain, cost)
        want[f] = (*best, best[1] < best[2]) if best else (None, 0, 0, True)
    df = lambda rows, c: spark.createDataFrame(rows, f"file bigint, {c}")
    got = seams.split_gains(df(units, "unit bigint, end bigint"), df(refs, "a bigint, b bigint"), df(clones + [(0, None, 5)], "s bigint, e bigint"), df(churn, "a bigint, b bigint")).collect()
    assert {r.file: (r.unit, r.benefit, r.cost, r.exempt) for r in got} == want
    assert {w[3] for w in want.values()} == {True, False}
    empty = seams.split_gains(df([], "unit bigint, end bigint"), df([], "a bigint, b bigint"), df([], "s bigint, e bigint"), df([], "a bigint, b bigint"))
    assert empty.collect() == []
