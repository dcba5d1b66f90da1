"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of each text.

A window is `window` consecutive item words; an item of fewer words, but not none,
is one window. Defined results: null or empty texts and items have no words; rows of one
item_id count as one item; an empty benchmark hits nothing; an item with null id takes part in
hits but not in the items; repeated documents each give a row; texts of any length are scanned whole.

The windows reach executors as one broadcast automaton while there are at most
`most_windows` of them. A larger benchmark is dealt out, window by window, over several passes of about that size; rows are
numbered and written before, passes come and go one at a time, and neither the driver nor a broadcast ever holds more than one.
"""

from __future__ import annotations

from collections.abc import Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD_BYTES, WORD_FOLD, column, field, fold_words, map_texts, materialise, packed, share, ship_code, tidy, unpacked

WINDOW = 10
#: Windows in one automaton; about 60 bytes of executor memory for each of their letters.
MOST_WINDOWS = 200_000


def windows_of(items: Iterable[tuple[str, bytes]], window: int) -> dict[str, set[str]]:
    """Window, space-joined, to the ids of the items that have it."""
    out: dict[str, set[str]] = {}
    for item, text in items:
        words = [w.decode("latin-1") for w in fold_words(text)]
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            out.setdefault(" ".join(words[i : i + n]), set()).add(item)
    return out


class Scanner:
    """Finds all windows in a text; word positions come from counting blanks, character spans from the original."""

    def __init__(self, windows: dict[str, set[str]]):
        self.automaton = ahocorasick.Automaton()
        for w, items in windows.items():
            self.automaton.add_word(f" {w} ", (w.count(" ") + 1, len(w) + 2, items))
        self.some = bool(windows)
        if self.some:
            self.automaton.make_automaton()

    def finds(self, text: bytes) -> bool:
        if not self.some:
            return False
        line = f" {b' '.join(text.translate(WORD_FOLD).split()).decode('latin-1')} "
        return next(self.automaton.iter(line), None) is not None

    def __call__(self, text: bytes) -> tuple[int, int, list[str], list[tuple[int, int]]]:
        words = text.translate(WORD_FOLD).split()
        if not words or not self.some:
            return len(words), 0, [], []
        line = f" {b' '.join(words).decode('latin-1')} "
        found = list(self.automaton.iter(line))
        if not found:
            return len(words), 0, [], []
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        first = np.searchsorted(blanks, [end - v[1] + 1 for end, v in found])
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, first, 1)
        np.add.at(edge, first + [v[0] for _, v in found], -1)
        hit = np.cumsum(edge[:-1]) > 0
        items = set().union(*{id(v[2]): v[2] for _, v in found}.values())
        turns = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)
        places = [m.span() for m in WORD_BYTES.finditer(text)]
        spans = [(places[a][0], places[b - 1][1]) for a, b in turns]
        return len(words), int(hit.sum()), sorted(x for x in items if x is not None), spans


def _windows(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """(win, items): every window, space-joined, with the distinct ids of its items."""
    ship_code(benchmark.sparkSession)

    def run(batches):
        for batch in batches:
            wins, items = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                for w in windows_of([(item, text)], window):
                    wins.append(w.encode("latin-1"))
                    items.append(item)
            yield pa.RecordBatch.from_arrays([pa.array(wins, pa.binary()), pa.array(items, pa.string())], names=["win", "item"])
        tidy()

    source = benchmark.select(column(item_id).cast("string").alias("item"), column(item_text).cast("binary").alias("text"))
    found = source.where("text is not null").mapInArrow(run, "win binary, item string")
    # an item without id counts as hits only: collect_set leaves nulls out
    return found.groupBy("win").agg(F.collect_set("item").alias("items"))


def _passes(windows: DataFrame, most_windows: int) -> tuple[int, DataFrame]:
    """The number of passes, and the windows to take them from."""
    kept = materialise(windows, "windows")
    return max(1, -(-kept.count() // most_windows)), kept


def _one(windows: DataFrame, number: int, passes: int) -> dict[str, set[str]]:
    """The windows of one pass, on the driver."""
    mine = windows.where(F.pmod(F.xxhash64("win"), F.lit(passes)) == number)
    return {bytes(r["win"]).decode("latin-1"): set(r["items"]) for r in mine.toLocalIterator()}


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, most_windows: int = MOST_WINDOWS) -> DataFrame:
    """The documents, all their columns, in which no item's window occurs. Passes filter one after another."""
    spark = docs.sparkSession
    passes, windows = _passes(_windows(benchmark, "item_id", "text", window), most_windows)
    rows = packed(docs, docs.columns, text=column(text))
    for number in range(passes):
        shared = share(spark, _one(windows, number, passes))

        def make(shared=shared):
            scanner = Scanner(shared.value)
            return lambda texts: [pa.array([scanner.finds(t) for t in texts], pa.bool_())]

        rows = map_texts(rows, ["kept", "text"] if number + 1 < passes else ["kept"], [field("leaked", "boolean")], make).where("not leaked")
        if number + 1 < passes:
            rows = materialise(rows.drop("leaked"), "clean")
            shared.unpersist()
    return unpacked(rows, docs.columns)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    most_windows: int = MOST_WINDOWS,
) -> DataFrame:
    """One row a document: words, hit words, items, spans of hit words as byte offsets in the original text."""
    spark = docs.sparkSession
    passes, windows = _passes(_windows(benchmark, item_id, item_text, window), most_windows)
    if passes == 1:
        return _one_pass(docs, id_column, text, _one(windows, 0, 1), spark)
    numbered = packed(docs, [id_column], row=F.monotonically_increasing_id(), text=column(text))
    rows = unpacked(materialise(numbered, "numbered"), [id_column], F.col("row").alias("loom_row"), F.col("text").alias("loom_text"))
    whole = None
    for number in range(passes):
        done = materialise(_one_pass(rows, id_column, "loom_text", _one(windows, number, passes), spark, ["loom_row"]), "pass")
        whole = done if whole is None else whole.unionByName(done)
    return _merged(whole, id_column)


def _merged(whole: DataFrame, id_column: str) -> DataFrame:
    """Several passes over the same row: spans may overlap, so the hit words are the union of their numbers."""
    merged = whole.groupBy("loom_row").agg(
        F.first(id_column).alias(id_column),
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    return merged.select(
        id_column, "n_words", F.size("hits").cast("bigint").alias("n_hit"), "items", "spans"
    )


def _one_pass(docs, id_column, text, windows, spark, more=()) -> DataFrame:
    shared = share(spark, windows)
    fields = [field("n_words", "bigint"), field("n_hit", "bigint"), field("items", "array<string>")]
    fields += [field("spans", "array<struct<start:bigint,stop:bigint>>")]
    if more:
        fields.append(field("hits", "array<bigint>"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def make():
        scanner = Scanner(shared.value)

        def work(texts: list[bytes]) -> list[pa.Array]:
            out = [scanner(t) for t in texts]
            cols = [
                pa.array([x[0] for x in out], pa.int64()),
                pa.array([x[1] for x in out], pa.int64()),
                pa.array([x[2] for x in out], pa.list_(pa.string())),
                pa.array([[{"start": a, "stop": b} for a, b in x[3]] for x in out], span),
            ]
            if more:
                cols.append(pa.array([_numbers(t, x[3]) for t, x in zip(texts, out)], pa.list_(pa.int64())))
            return cols

        return work

    return map_texts(docs, [*more, id_column], fields, make, text)


def _numbers(text: bytes, spans: list[tuple[int, int]]) -> list[int]:
    """Numbers of the words inside the spans."""
    out, k = [], 0
    for i, m in enumerate(WORD_BYTES.finditer(text) if spans else ()):
        while k < len(spans) and m.start() >= spans[k][1]:
            k += 1
        if k < len(spans) and m.start() >= spans[k][0]:
            out.append(i)
    return out


def items_digest(items: str = "items"):
    """The sha256 of the sorted item ids joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.col(items)), ",").cast("binary"), 256)
