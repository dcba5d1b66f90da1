"""Exact ranked search of documents for the items of a table, by geometric blocks of posting lists.

Texts are read once: every document becomes the numbers and frequencies of the terms that items have, beside its length. Statistics are partial
aggregates. A task then takes documents in shards of bounded size and turns each into posting lists. A term's list is clustered by the similarity
of its documents (nearest of several centroids, over random projections of their weighted terms) into blocks; a block keeps the coordinatewise maximum
of its documents' impacts as a summary. Terms are taken by falling weight. Whoever holds an earlier term of an item has been judged there, so
a block's bound adds up the summary over the terms that are left; a block is passed over only if that bound is below the item's worst score so far. Bounds and
scores are whole numbers, so nothing is lost. The floors start from the scores in a part of the documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD_FOLD, column, materialise, ship_code, share, slices, as_bytes, texts_of, tidy
from sparkloom.llm.pieces import _ranges

K = 50
#: Terms of items and items that one pass over the documents takes; more items are dealt to several passes.
MOST_TERMS, MOST_ITEMS = 200_000, 20_000
#: Documents and postings of a shard, documents of a block, numbers of a projection.
SHARD_DOCS, SHARD_POSTINGS, BLOCK, SHADOW = 8192, 1_000_000, 32, 16
#: Floors come from one document in so many, where the table has at least so many.
SEED_SHARE, SEED_FROM = 32, 100_000
#: Bytes of a text that are split at once.
STRETCH = 1 << 20
LARGEST = np.iinfo(np.int64).max


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded size."""
    line = text.translate(WORD_FOLD)
    at = 0
    while at < len(line):
        stop = line.find(b" ", at + STRETCH)
        stop = len(line) if stop < 0 else stop
        yield line[at:stop].split()
        at = stop


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term), distinct: rows of one id are one item, those without id too."""
    ship_code(items.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column("item"), as_bytes(batch.column("text"))], names=["item", "text"])
            for part in slices(whole, "text"):
                at, terms = [], []
                for i, t in enumerate(texts_of(part)):
                    mine = set().union(*_words(t))
                    terms.extend(mine)
                    at.extend([i] * len(mine))
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(at, pa.int64())), pa.array(terms, pa.binary())], names=["item", "term"])
        tidy()

    source = items.select(column(item_id).cast("bigint").alias("item"), column(text).cast("string").alias("text"))
    return source.where("text is not null").mapInArrow(run, "item bigint, term binary").distinct()


def term_counts(docs: DataFrame, vocabulary, id_column: str, text: str) -> DataFrame:
    """(doc, n, terms, tfs) of each document: its terms in all, and those of the vocabulary, a broadcast of term to number, with their counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column("doc"), as_bytes(batch.column("text"))], names=["doc", "text"])
            for part in slices(whole, "text"):
                n, terms, tfs = [], [], []
                for t in texts_of(part):
                    count, seen = 0, []
                    for words in _words(t):
                        count += len(words)
                        found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                        seen.append(found[found >= 0])
                    n.append(count)
                    term, tf = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.int32),) * 2
                    terms.append(term)
                    tfs.append(tf)
                ends = np.append(0, np.cumsum(np.fromiter(map(len, terms), np.int64, len(terms)))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x).astype(np.int32))) for x in (terms, tfs)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])
        tidy()

    source = docs.select(column(id_column).cast("bigint").alias("doc"), column(text).cast("string").alias("text"))
    return source.mapInArrow(run, "doc bigint, n bigint, terms array<int>, tfs array<int>")


class Shard:
    """Documents of bounded number as rows of (term, impact), and as posting lists."""

    def __init__(self, doc: np.ndarray, m: np.ndarray, size: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        self.doc, self.size, self.term, self.weight = doc, size, term, weight
        self.start = np.cumsum(size) - size
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size))
        row = np.repeat(np.arange(len(doc)), size)
        order = np.argsort(term, kind="stable")
        self.posted = row[order]
        # posting list of term t: posted[first[t] : first[t + 1]]
        self.first = np.searchsorted(term[order], np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), np.int64)
        np.maximum.at(self.most, term, self.impact)
        self._shadow: np.ndarray | None = None

    def shadow(self) -> np.ndarray:
        """Unit vectors of few numbers whose products follow those of the documents' weighted terms."""
        if self._shadow is None:
            base = np.random.default_rng(7).standard_normal((len(self.weight), SHADOW)).astype(np.float32)
            out = np.zeros((len(self.doc), SHADOW), np.float32)
            some = np.flatnonzero(self.size)
            value = (self.weight[self.term] * self.impact).astype(np.float32)
            for k in range(SHADOW):
                out[some, k] = np.add.reduceat(base[self.term, k] * value, self.start[some])
            self._shadow = out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
        return self._shadow

    def blocks(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents of a posting list, block after block, and where the blocks begin and end."""
        rows = self.posted[self.first[term] : self.first[term + 1]]
        count = -(-len(rows) // BLOCK)
        if count < 2:
            return rows, np.array([0, len(rows)])
        shadow = self.shadow()
        centre = shadow[rows[np.linspace(0, len(rows) - 1, count).astype(np.int64)]]
        near = np.concatenate([(shadow[rows[a : a + 4096]] @ centre.T).argmax(axis=1) for a in range(0, len(rows), 4096)])
        order = np.argsort(near, kind="stable")
        return rows[order], np.append(np.flatnonzero(np.diff(near[order], prepend=-1)), len(rows))

    def summaries(self, rows: np.ndarray, edge: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The largest impact in each block of each wanted term (sorted)."""
        size = self.size[rows]
        at = _ranges(self.start[rows], size)
        term = self.term[at]
        place = np.minimum(np.searchsorted(wanted, term), len(wanted) - 1)
        here = wanted[place] == term
        block = np.repeat(np.repeat(np.arange(len(edge) - 1), np.diff(edge)), size)
        out = np.zeros((len(edge) - 1, len(wanted)), np.int64)
        np.maximum.at(out, (block[here], place[here]), self.impact[at[here]])
        return out

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Exact scores; `weight` is that of each term, zero for those the item has not."""
        size = self.size[rows]
        at = _ranges(self.start[rows], size)
        return np.add.reduceat(weight[self.term[at]] * self.impact[at], np.cumsum(size) - size)


class Best:
    """The k best of each item: highest score first, then the smaller id, ids that are null last."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor = k, floors.copy()
        self.top: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3 for _ in floors]

    def new_shard(self) -> None:
        """Rows of the shard before are none of the next one."""
        self.top = [(s, d, np.full(len(r), -1)) for s, d, r in self.top]

    def offer(self, item: int, score: np.ndarray, doc: np.ndarray, row: np.ndarray) -> None:
        s, d, r = self.top[item]
        new = (score >= self.floor[item]) & ~np.isin(row, r)
        if not new.any():
            return
        s, d, r = np.concatenate([s, score[new]]), np.concatenate([d, doc[new]]), np.concatenate([r, row[new]])
        order = np.lexsort([d, -s])[: self.k]
        self.top[item] = s[order], d[order], r[order]
        if len(order) == self.k:
            self.floor[item] = max(self.floor[item], s[order[-1]])


def search_shard(shard: Shard, items: list[np.ndarray], holders: list[np.ndarray], best: Best) -> int:
    """Offer every document that can be among an item's best. `items` hold terms by falling weight; `holders` the items of a term. Gives the number of blocks that were opened."""
    weight, opened = shard.weight, 0
    # what all terms from each place on can add, in this shard
    ahead = [np.append(np.cumsum((weight[t] * shard.most[t])[::-1])[::-1], 0) for t in items]
    exact = np.float64 if max((int(a[0]) for a in ahead), default=0) < 1 << 53 else np.int64
    own = np.zeros(len(weight), np.int64)
    for term in np.lexsort([np.arange(len(weight)), -weight]).tolist():
        if shard.first[term] == shard.first[term + 1] or not len(holders[term]):
            continue
        live = []
        for i in holders[term].tolist():
            place = int(np.flatnonzero(items[i] == term)[0])
            if ahead[i][place] >= best.floor[i]:
                live.append((i, items[i][place:]))
        if not live:
            continue
        rows, edge = shard.blocks(term)
        wanted = np.unique(np.concatenate([t for _, t in live]))
        summary = shard.summaries(rows, edge, wanted).astype(exact)
        for i, left in live:
            at = np.searchsorted(wanted, left)
            bound = summary[:, at] @ weight[left].astype(exact)
            order = np.argsort(-bound, kind="stable")
            order = order[bound[order] >= best.floor[i]]
            own[items[i]] = weight[items[i]]
            a, step = 0, 1
            while a < len(order) and bound[order[a]] >= best.floor[i]:
                some = order[a : a + step]
                mine = rows[_ranges(edge[some], edge[some + 1] - edge[some])]
                best.offer(i, shard.scores(mine, own), shard.doc[mine], mine)
                opened += len(some)
                a, step = a + step, step * 2
            own[items[i]] = 0
    return opened


def _search(counted: DataFrame, shared, k: int) -> DataFrame:
    """(item, doc, score): each task's best of the documents (doc, m, terms, tfs)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, items, names, floors = shared.value
        items = [t[np.lexsort([t, -weight[t]])] for t in items]
        flat = np.concatenate(items)
        whose = np.repeat(np.arange(len(items)), [len(t) for t in items])
        order = np.argsort(flat, kind="stable")
        holders = np.split(whose[order], np.searchsorted(flat[order], np.arange(1, len(weight))))
        best = Best(floors, k)
        held: list[pa.RecordBatch] = []
        docs = postings = 0

        def search() -> None:
            cols = [pa.concat_arrays([b.column(c) for b in held]) for c in ("doc", "m", "terms", "tfs")]
            doc = cols[0].fill_null(LARGEST).to_numpy(zero_copy_only=False)
            size = np.diff(cols[2].offsets.to_numpy())
            term, tf = (c.flatten().to_numpy(zero_copy_only=False) for c in cols[2:])
            best.new_shard()
            search_shard(Shard(doc, cols[1].to_numpy(zero_copy_only=False), size.astype(np.int64), term.astype(np.int64), tf.astype(np.int64), weight), items, holders, best)

        for batch in batches:
            step = max(1, min(SHARD_DOCS // 4, batch.num_rows * SHARD_POSTINGS // (4 * (len(batch.column("terms").flatten()) + 1))))
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                held.append(part)
                docs, postings = docs + part.num_rows, postings + len(part.column("terms").flatten())
                if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                    search()
                    held, docs, postings = [], 0, 0
        if held:
            search()
        for i, (score, doc, _) in enumerate(best.top):
            if len(score):
                there = pa.array(doc, mask=doc == LARGEST)
                yield pa.RecordBatch.from_arrays([pa.array([names[i]] * len(score), pa.int64()), there, pa.array(score)], names=["item", "doc", "score"])
        tidy()

    return counted.mapInArrow(run, "item bigint, doc bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_column: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    most_terms: int = MOST_TERMS,
    most_items: int = MOST_ITEMS,
    seed_from: int = SEED_FROM,
) -> DataFrame:
    """item_id, rank from 1, doc_id, score: each item's k best documents of score above 0, equal scores by ascending id (null last).

    Ids are whole numbers below 2^63 - 1. Items of one id are one item with the terms of all; items and documents without terms have no rows. Repeated documents are ranked each for itself.
    Further columns are not read. Items beyond `most_terms` terms or `most_items` are dealt to several passes over the documents, whose results are whole.
    """
    spark = docs.sparkSession
    ship_code(spark)
    asked = materialise(item_terms(items, item_id, item_text), "item-terms")
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.countDistinct(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("items")).first()
    empty = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    if not size["terms"]:
        return empty
    passes = max(-(-size["terms"] // most_terms), -(-size["items"] // most_items))
    found = None
    for number in range(passes):
        mine = asked.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == number)
        part = _one_pass(docs, mine, k, id_column, text, seed_from)
        if part is not None:
            found = part if found is None else found.unionByName(part)
    return found if found is not None else empty


def _one_pass(docs: DataFrame, asked: DataFrame, k: int, id_column: str, text: str, seed_from: int) -> DataFrame | None:
    spark = docs.sparkSession
    # bounded by most_terms and most_items
    rows = [(r["item"], bytes(r["term"])) for r in asked.collect()]
    if not rows:
        return None
    number = {t: i for i, t in enumerate(sorted({t for _, t in rows}))}
    by_item: dict = {}
    for item, term in rows:
        by_item.setdefault(item, []).append(number[term])
    names = list(by_item)
    terms = [np.array(t, np.int64) for t in by_item.values()]
    vocabulary = share(spark, number)
    counted = materialise(term_counts(docs, vocabulary, id_column, text), "counted")
    totals = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
    count, length = totals["docs"], totals["all"]
    if not count:
        return None
    held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = F.floor(F.lit(1000) * F.log((F.lit(2) * count + 2).cast("double") / (2 * F.col("df") + 1)))
    weight = np.zeros(len(number), np.int64)
    for r in held.select("term", w.cast("bigint").alias("w")).toLocalIterator():
        weight[r["term"]] = r["w"]
    n = F.col("n")
    usable = counted.where(F.size("terms") > 0).select(
        "doc", "n", (F.lit(50) + F.call_function("div", F.lit(50) * n * F.lit(count).cast("bigint"), F.lit(length).cast("bigint"))).alias("m"), "terms", "tfs"
    )
    floors = np.ones(len(names), np.int64)
    if count >= seed_from:
        seed = usable.where(F.pmod(F.xxhash64("doc", "n"), F.lit(SEED_SHARE)) == 0)
        ranked = _best(_search(seed, share(spark, (weight, terms, names, floors)), k), k)
        worst = ranked.where(F.col("rank") == k).select("item", "score")
        place = {x: i for i, x in enumerate(names)}
        for r in worst.toLocalIterator():
            floors[place[r["item"]]] = r["score"]
    found = _search(usable, share(spark, (weight, terms, names, floors)), k)
    return _best(found, k).select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
