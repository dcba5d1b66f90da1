"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of labelled text. A text is parsed, left to right, into
the longest phrases that occur in a language's sample; the language that needs the fewest
phrases a character wins. Automata become dense tables, and all blocks of a batch of
texts are parsed in step, one character of each at a time. A block is first parsed as if a phrase began with it; then the
phrase that reaches into it is carried on from the block before, until both parses begin a phrase at one place, from
where on they agree. Counts are hence those of the whole text, without any cut.

The fit takes at most `most_texts` texts of each language, those of smallest id hash, and of each a passage at a place chosen by
hash, so that a language's sample has about `most_chars` characters, and all samples together at most `TOTAL_CHARS`: with more
than `TOTAL_CHARS / most_chars` languages each gets less, and of over `MOST_LANGS` those with most rows are learned. Letters are not limited: the
commonest of all samples index dense tables, the others are looked up among the transitions that exist. Samples and texts are both
brought to composed form (NFC) and lower case.

Defined results: null texts and texts without a letter are `und` with score 0; no labelled row makes every
text `und`; among languages that need equally few phrases (as on a text whose letters no sample has) the one with most labelled
rows wins, with score 0; texts of any length are parsed whole; repeated rows each give a row.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import column, field, map_texts, share

MOST_TEXTS, MOST_CHARS, BLOCK = 60, 12_000, 512
#: Characters of all samples; a table takes about 400 bytes for each.
TOTAL_CHARS, MOST_LANGS = 250_000, 500
SYMBOLS = 64
#: Bits of a table entry from which on the phrases that end are counted.
_COUNT = 29
_STATE = (1 << _COUNT) - 1


def normalise(text: str) -> str:
    """Lower case; every run of other than letters becomes one blank."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


@dataclass
class Table:
    """Transitions of a language. Where phrases must end: how many, above bit `_COUNT`, and the state that the character starts anew."""

    dense: np.ndarray  # by state and symbol below SYMBOLS
    keys: np.ndarray  # state * size of the alphabet + symbol of each transition by a symbol from SYMBOLS on, ascending
    targets: np.ndarray
    fresh: np.ndarray  # by symbol, the entry where no transition goes on
    root: np.ndarray  # by symbol, the entry of state 0

    def look_up(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries for symbols from SYMBOLS on."""
        out = np.where(state > 0, self.fresh[symbol], self.root[symbol])
        if len(self.keys):
            want = state.astype(np.int64) * len(self.fresh) + symbol
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            out = np.where(self.keys[at] == want, self.targets[at], out)
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray, rare: np.ndarray, rare_symbol: np.ndarray) -> np.ndarray:
        """Entries for the next symbol of each row; at `rare` rows it is one from SYMBOLS on."""
        to = self.dense[state * SYMBOLS + symbol]
        if len(rare):
            to[rare] = self.look_up(state[rare], rare_symbol)
        return to


def table_of(sample: str, alphabet: dict[str, int]) -> Table:
    """Symbol 0, a character unknown to all samples, continues no phrase."""
    steps = suffix_automaton([alphabet.get(c, 0) for c in sample])
    wide = max(SYMBOLS, len(alphabet) + 1)
    table = np.full((len(steps), SYMBOLS), -1, np.int32)
    rare = []
    for s, outs in enumerate(steps):
        for c, t in outs.items():
            if c >= SYMBOLS:
                rare.append((s * wide + c, t))
            elif c:
                table[s, c] = t
    rare.sort()
    first = np.full(wide, -1, np.int32)
    first[:SYMBOLS] = table[0]
    for c, t in steps[0].items():
        first[c] = t if c else -1
    # a character that the sample lacks is a phrase of its own: it ends the one before it, if any, and itself
    fresh = np.where(first < 0, 2 << _COUNT, first | (1 << _COUNT)).astype(np.int32)
    root = np.where(first < 0, 1 << _COUNT, first).astype(np.int32)
    table = np.where(table < 0, fresh[None, :SYMBOLS], table)
    table[0] = root[:SYMBOLS]
    keys, targets = np.array([k for k, _ in rare], np.int64), np.array([t for _, t in rare], np.int32)
    return Table(table.astype(np.int32).ravel(), keys, targets, fresh, root)


@dataclass
class Parser:
    names: list[str]
    tables: list[Table]
    symbols: np.ndarray  # code point (below 65536) to symbol; blanks stand for all that is no letter
    blank: int
    beyond: dict[str, int]  # symbols of letters from code point 65536 on
    order: np.ndarray  # languages by labelled rows, most first
    weight: np.ndarray  # logarithm of the length of each language's sample

    def codes(self, text: str) -> np.ndarray:
        """Symbols of the normalised text; empty if it has no letter."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        out = self.symbols[np.minimum(points, 65535)]
        other = points > 65535
        if other.any():
            out = out.copy()
            out[other] = [self.beyond.get(chr(c).lower()[0], 0) if chr(c).isalpha() else self.blank for c in points[other].tolist()]
        keep = out != self.blank
        if not keep.any():
            return out[:0]
        keep[1:] |= keep[:-1]  # one blank after a letter stays
        return out[keep]

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, characters by text)."""
        codes = [self.codes(t) for t in texts]
        size = np.array([len(c) for c in codes])
        blocks = (size + BLOCK - 1) // BLOCK
        owner = np.repeat(np.arange(len(texts)), blocks)
        flat = np.concatenate([*codes, np.zeros(BLOCK, self.symbols.dtype)])
        base = np.repeat(np.cumsum(size) - size, blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = base + number * BLOCK
        long = np.minimum(size[owner] - number * BLOCK, BLOCK)
        order = np.argsort(-long, kind="stable")
        start, long, owner = start[order], long[order], owner[order]
        active = np.searchsorted(-long, -np.arange(1, BLOCK + 1), "right")  # blocks that have a j-th character
        counts = np.zeros((len(texts), len(self.names)), np.int64)
        columns = []
        for j, n in enumerate(active):
            if n:
                c = flat[start[:n] + j].astype(np.int32)
                rare = np.flatnonzero(c >= SYMBOLS)
                columns.append((np.where(c < SYMBOLS, c, 0) if len(rare) else c, rare, c[rare]))
        # a block goes on from the one before it of the same text, if any
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        before = np.where(number[order] > 0, place[np.maximum(order - 1, 0)], -1)
        final = number[order] == blocks[owner] - 1
        for k, table in enumerate(self.tables):
            state = np.zeros(len(start), np.int32)
            ended = np.zeros((len(columns), len(start)), np.int8)
            fresh = np.zeros((len(columns), len(start)), bool)  # whether a phrase begins with this character
            for j, (c, rare, symbol) in enumerate(columns):
                n = len(c)
                to = table.step(state[:n], c, rare, symbol)
                ended[j, :n] = to >> _COUNT
                fresh[j, :n] = (state[:n] == 0) | (ended[j, :n] > 0)
                state[:n] = to & _STATE
            total = ended.sum(0, dtype=np.int64)
            carried = np.zeros(len(start), np.int32)  # the state that each block was last parsed from
            todo = np.flatnonzero(before >= 0)
            while len(todo):
                into = state[before[todo]]
                todo = todo[into != carried[todo]]
                carried[todo] = state[before[todo]]
                rows, s = todo, carried[todo]
                moved = []
                for j, (c, rare, symbol) in enumerate(columns):
                    rows, s = rows[rows < len(c)], s[: np.searchsorted(rows, len(c))]
                    if not len(rows):
                        break
                    at = np.full(len(c), -1)
                    at[rows] = np.arange(len(rows))
                    odd = np.flatnonzero(at[rare] >= 0) if len(rare) else rare
                    to = table.step(s, c[rows], at[rare[odd]] if len(odd) else odd, symbol[odd] if len(odd) else odd)
                    new = to >> _COUNT
                    begins = (s == 0) | (new > 0)
                    agree = begins & fresh[j, rows]
                    total[rows] += new - ended[j, rows]
                    ended[j, rows] = new
                    fresh[j, rows] = begins
                    s = to & _STATE
                    ends = long[rows] == j + 1
                    stop = ends & ~agree
                    state[rows[stop]] = s[stop]
                    moved.append(rows[stop])
                    go = ~agree & ~ends
                    rows, s = rows[go], s[go]
                todo = np.flatnonzero(np.isin(before, np.concatenate([np.zeros(0, np.int64), *moved])))
            counts[:, k] = np.bincount(owner, total + (final & (state > 0)), len(texts))
        return counts, size

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        if not self.names or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        counts, size = self.phrases([unicodedata.normalize("NFC", t.decode("utf-8", "replace")) for t in texts])
        names, scores = [], []
        for c, n in zip(counts, size):
            if not n:
                names.append("und")
                scores.append(0.0)
                continue
            # a phrase of a longer sample is longer by its logarithm: phrases times that estimate the cross entropy
            c = c * self.weight if (c != c[0]).any() else c * 1.0
            best = int(self.order[np.argmin(c[self.order])])
            rest = np.delete(c, best)
            names.append(self.names[best])
            # how far the runner-up is behind, 0 (equal) to 1
            scores.append(1.0 if not len(rest) else float(1 - c[best] / rest.min()))
        return names, scores


def parser_of(samples: dict[str, str], rows: dict[str, int] | None = None) -> Parser:
    """Every letter of the samples has a symbol, the commonest below SYMBOLS; letters of no sample share symbol 0."""
    count: dict[str, int] = {}
    for text in samples.values():
        for c in set(text) - {" "}:
            count[c] = count.get(c, 0) + text.count(c)
    letters = sorted(count, key=lambda c: (-count[c], c))
    alphabet = {" ": 1} | {c: i + 2 for i, c in enumerate(letters)}
    symbols = np.ones(65536, np.uint8 if len(alphabet) < 256 else np.uint32)
    for point in range(65536):
        c = chr(point)
        if c.isalpha():
            low = c.lower()
            symbols[point] = alphabet.get(low if len(low) == 1 else low[0], 0)
    names = sorted(samples)
    order = np.array(sorted(range(len(names)), key=lambda i: (-(rows or {}).get(names[i], 0), names[i])), np.int64)
    beyond = {c: i for c, i in alphabet.items() if ord(c) > 65535}
    weight = np.log([len(samples[n]) + 1 for n in names])
    return Parser(names, [table_of(samples[n], alphabet) for n in names], symbols, 1, beyond, order, weight)


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", most_texts: int = MOST_TEXTS, most_chars: int = MOST_CHARS) -> Parser:
    """Learn from rows with a language and an id; ids are chosen first, so that only a passage of their texts is read on the driver."""
    spark = docs.sparkSession
    known = docs.select(column(id_column).alias("id"), column(lang).cast("string").alias("lang"), column(text).cast("string").alias("text")).where(
        "lang is not null and id is not null and text is not null"
    )
    rows = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGS).collect()}
    known = known.where(F.col("lang").isin(list(rows)))
    chars = min(most_chars, TOTAL_CHARS // max(1, len(rows)))
    h = F.xxhash64(F.col("id").cast("string"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(h, "id"))
    ids = known.select("id", "lang").withColumn("rank", rank).where(F.col("rank") <= most_texts)
    few = spark.createDataFrame(ids.select("id").distinct().collect(), known.select("id").schema)
    # twice the letters that a passage gives to the sample, for what normalising takes away
    share_of = max(100, chars // most_texts)
    start = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(17)), F.greatest(F.length("text") - 2 * share_of, F.lit(0)) + 1).cast("int") + 1
    got = known.join(F.broadcast(few), "id").select("lang", F.substring(F.col("text"), start, F.lit(2 * share_of)).alias("text"), h.alias("h")).dropDuplicates(["lang", "text"]).collect()
    samples: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r[0], r["h"], r["text"])):
        passage = normalise(unicodedata.normalize("NFC", r["text"]))[:share_of]
        samples[r[0]] = (samples.get(r[0], "") + " " + passage)[:chars].strip()
    return parser_of({k: v for k, v in samples.items() if v}, rows)


def identify(docs: DataFrame, parser: Parser, keep: list[str], text: str = "text") -> DataFrame:
    """`keep`, `lang_pred` and `score` of every whole text."""
    shared = share(docs.sparkSession, parser)

    def make():
        p = shared.value

        def work(texts: list[bytes]) -> list[pa.Array]:
            names, scores = p.predict(texts)
            return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]

        return work

    return map_texts(docs, keep, [field("lang_pred", "string"), field("score", "double")], make, text)
