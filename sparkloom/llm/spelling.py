"""Grouping spelling variants: words one edit apart, found by dense tiles over padded code-point matrices.

One edit lies in one stretch of a word, and the rest of both words is equal. So words are keyed by what is left when a stretch is left out: first each half;
a group of over `TILE` words is keyed again by quarters, and so on, until stretches are single letters and a group is bounded by the
alphabet. No group is ever paired whole by rows: in a task, blocks of a group's words are laid out as padded matrices,
pairs of blocks are compared at once, and two words are near if their common prefix and common suffix together reach the longer length less
one. A pair counts in the stretch that holds its first differing letter alone, so it counts once, and what leaves a task is one row a word,
not a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import column, materialise, partitions, remove, ship_code, tidy

#: Runs of letters: ASCII and the upper half of Latin-1, so that a letter is one byte of a matrix.
RUN = "([A-Za-zÀ-ÿ]+)"
LEAST_LETTERS, LEAST_COUNT, RATIO, SLIP = 6, 5, 5, 199
#: Words of a group beyond which it is keyed anew, words of a block, letters compared at once, words gathered for one step.
TILE, BLOCK, CELLS, ROWS = 4096, 64, 1 << 22, 8192
#: Keys of groups beyond `TILE` that are broadcast.
MOST_KEYS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", slip: int = SLIP, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many letters and occurrences.

    A run whose crc32 of `<id>:<run>` is divisible by `slip` loses the letter at that number modulo its length, as a slip of the pen that is the
    same in each rerun; `slip` 0 changes nothing. A null id reads as empty.
    """
    runs = docs.select(column(id_column).cast("string").alias("id"), F.explode(F.regexp_extract_all(column(text).cast("string"), F.lit(RUN), F.lit(1))).alias("run"))
    # a run only ever gets shorter
    low = runs.where(F.length("run") >= least_letters).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    if slip:
        h = F.crc32(F.encode(F.concat(F.coalesce("id", F.lit("")), F.lit(":"), F.col("run")), "utf-8"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
        low = low.withColumn("h", h).select(F.when(F.col("h") % slip == 0, cut).otherwise(F.col("run")).alias("run"))
    counted = low.where(F.length("run") >= least_letters).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= least_count)


def _edge(m, s, level: int):
    """Where stretch s of 2^level begins in a word of m letters: floor(m s / 2^level)."""
    return F.shiftright(m * s, level)


def _keyed(rows: DataFrame, level: int) -> DataFrame:
    """Rows (word, n, m, s) with the key of what is left of the word without stretch s; empty stretches go. A word of m + 1 letters leaves out one more."""
    start, stop = _edge(F.col("m"), F.col("s"), level), _edge(F.col("m"), F.col("s") + 1, level)
    left = F.xxhash64(F.substring("word", F.lit(1), start), F.substring("word", stop + 1 + F.length("word") - F.col("m"), F.length("word")))
    return rows.where(start < stop).select("word", "n", "m", "s", left.alias("key"))


def near_in_groups(words: list[bytes], n: np.ndarray, m: int, start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), numbers of near words of one group, each pair once. Words have m or m + 1 letters and are sorted by group.

    `start` and `stop` are the stretch of each word's group.
    """
    count, width = len(words), m + 2
    size = np.fromiter(map(len, words), np.int64, count)
    left = np.zeros((count + 1, width), np.uint8)
    right = np.zeros((count + 1, width), np.uint8)
    for k in (m, m + 1):
        at = np.flatnonzero(size == k)
        if len(at):
            letters = np.frombuffer(b"".join([words[i] for i in at.tolist()]), np.uint8).reshape(-1, k)
            left[at, :k], right[at, :k] = letters, letters[:, ::-1]
    # padding differs on both sides, so it never counts as equal, and the last column ends every prefix
    other_left, other_right = np.where(left, left, 1), np.where(right, right, 1)
    edge = np.append(np.flatnonzero(np.diff(group, prepend=-1)), count)
    blocks, pairs = [], []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if b - a > 1:
            mine = [(x, min(x + BLOCK, b)) for x in range(a, b, BLOCK)]
            first = len(blocks)
            blocks.extend(mine)
            pairs.extend((first + i, first + j) for i in range(len(mine)) for j in range(i, len(mine)))
    if not pairs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blocks, pairs = np.array(blocks), np.array(pairs)
    length = np.diff(blocks, axis=1)[:, 0]
    tall = length[pairs].max(axis=1)
    found = []
    for low, high in zip((0, 2, 4, 8, 16, 32), (2, 4, 8, 16, 32, 64)):
        mine = pairs[(tall > low) & (tall <= high)]
        step = max(1, CELLS // (high * high * width))
        for k in range(0, len(mine), step):
            x, y = mine[k : k + step].T
            within = np.arange(high)
            # rows beyond a block's end are the padding row
            ra = np.where(within < length[x][:, None], blocks[x, 0][:, None] + within, count)
            rb = np.where(within < length[y][:, None], blocks[y, 0][:, None] + within, count)
            prefix = (left[ra][:, :, None] == other_left[rb][:, None]).argmin(axis=3)
            suffix = (right[ra][:, :, None] == other_right[rb][:, None]).argmin(axis=3)
            la, lb = np.append(size, 0)[ra], np.append(size, 0)[rb]
            longer, shorter = np.maximum(la[:, :, None], lb[:, None]), np.minimum(la[:, :, None], lb[:, None])
            near = (prefix + suffix >= longer - 1) & (shorter == m) & ((x != y)[:, None, None] | (ra[:, :, None] < rb[:, None]))
            at, i, j = np.nonzero(near)
            p = np.minimum(prefix[at, i, j], m - 1)
            a, b = ra[at, i], rb[at, j]
            mine_too = (start[a] <= p) & (p < stop[a])
            found.append((a[mine_too], b[mine_too]))
    return tuple(np.concatenate(c) for c in zip(*found))


def _compare(batches: Iterable[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (m, s, key): for each word its near words in the group (n_near), and the one of largest count, the first in order of those (best_n, best)."""
    held: list[tuple] = []
    letters = 0

    def flush(rows: list[tuple]) -> pa.RecordBatch | None:
        out = []
        a = 0
        while a < len(rows):
            m = rows[a][2]
            b = a
            while b < len(rows) and rows[b][2] == m:
                b += 1
            part = rows[a:b]
            words = [r[0].encode("latin-1") for r in part]
            n = np.array([r[1] for r in part], np.int64)
            s = np.array([r[3] for r in part], np.int64)
            key = np.array([r[4] for r in part], np.int64)
            group = np.cumsum((np.diff(s, prepend=s[0]) != 0) | (np.diff(key, prepend=key[0]) != 0))
            x, y = near_in_groups(words, n, m, m * s >> level, m * (s + 1) >> level, group)
            if len(x):
                rank = np.empty(len(words), np.int64)
                rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
                me, it = np.concatenate([x, y]), np.concatenate([y, x])
                order = np.lexsort([rank[it], -n[it], me])
                me, it = me[order], it[order]
                first = np.flatnonzero(np.diff(me, prepend=-1))
                count = np.diff(np.append(first, len(me)))
                out += [(part[i][0], c, part[j][1], part[j][0]) for i, j, c in zip(me[first].tolist(), it[first].tolist(), count.tolist())]
            a = b
        if not out:
            return None
        word, count, best_n, best = zip(*out)
        return pa.RecordBatch.from_arrays([pa.array(word), pa.array(count, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best)], names=["word", "n_near", "best_n", "best"])

    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for row in rows:
            if letters > ROWS * 16 and row[2:] != held[-1][2:]:
                done = flush(held)
                if done is not None:
                    yield done
                held, letters = [], 0
            held.append(row)
            letters += max(16, row[2])
    if held:
        done = flush(held)
        if done is not None:
            yield done
    tidy()


def near_words(words: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, best_n, best) of every word that has a near word; `words` are distinct, (word, n)."""
    spark = words.sparkSession
    ship_code(spark)
    size = F.length("word")
    # a word meets those of its length, and as the longer one those of one letter less
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("s"))
    found, level, steps = None, 1, []
    while rows is not None:
        keyed = _keyed(rows, level)
        hot = keyed.groupBy("m", "s", "key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > tile)
        # stretches of one letter cannot be cut further; a group is then bounded by the alphabet
        hot = materialise(hot.where(F.col("m") > 1 << level).select("m", "s", "key"), "crowded")
        many = hot.count()
        cold = keyed
        if many:
            crowded = F.broadcast(hot) if many <= MOST_KEYS else hot
            cold = keyed.join(crowded, ["m", "s", "key"], "left_anti")
            again = keyed.join(crowded, ["m", "s", "key"], "left_semi")
            rows = materialise(again.select("word", "n", "m", F.explode(F.array(F.col("s") * 2, F.col("s") * 2 + 1)).alias("s")), "finer")
            steps.append(rows)
        else:
            rows = None
        dealt = cold.select("word", "n", "m", "s", "key").repartition(partitions(spark), "m", "s", "key").sortWithinPartitions("m", "s", "key")
        part = dealt.mapInArrow(lambda b, level=level: _compare(b, level), "word string, n_near bigint, best_n bigint, best string")
        part = materialise(part, "near")
        remove(hot)
        found = part if found is None else found.unionByName(part)
        level += 1
    for step in steps:
        remove(step)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best")
    merged = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return merged.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form) ends. Counts grow along a chain, so there are no circles; steps double."""
    now = forms.select("word", F.col("form").alias("root"))
    written = None
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialise(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if written is not None:
            remove(written)
        written, now = after, after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def spelling_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    slip: int = SLIP,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    ratio: int = RATIO,
    tile: int = TILE,
) -> DataFrame:
    """word, form, root (strings), n, n_near, form_n of all words of the texts that are long and frequent enough.

    Null and empty texts have no words; repeated rows count again; a word of any length is compared whole; of near words with equal counts the first in
    code-point order is the form; further columns are not read. An empty table gives no rows.
    """
    words = materialise(word_counts(docs, id_column, text, slip, least_letters, least_count), "words")
    near = materialise(near_words(words, tile), "variants")
    joined = words.join(near, "word", "left")
    is_form = F.col("best_n") >= F.col("n") * ratio
    told = materialise(
        joined.select(
            "word",
            F.when(is_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "forms",
    )
    remove(near)
    last = roots(told.where("form is not null").select("word", "form"))
    return told.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
