"""Toxicity: a small convolutional text classifier, trained in numpy on shards of all labelled rows, scored on whole texts.

Words (ASCII-folded) are hashed to embeddings, the whole word and its first bytes each to one, and added
up; filters of several widths slide over them and the largest response of each feeds a logistic unit.

The fit takes every labelled row, with its whole text; equal texts count once. Rows are dealt by a hash of the text over shards of about `shard_rows` rows
and `shard_bytes` bytes of words; in every epoch each shard takes its steps from the same parameters, and the mean of what the shards come to begins the next
(an embedding's mean weighs a shard by its texts with that word). A fifth of the texts, by hash, is not trained on: exact counts by logit, in
steps of 1/1024, set the offset that puts the best overall threshold at 0.7 and the thresholds per language. The driver gets parameters and counts, never texts. Language
is used for thresholds alone, never for a score.

Defined results: null and empty texts have no words and score as a text of unknown words; a
missing or one-sided label set gives every text score 0; repeated rows each give a row; of equal texts with several labels that of the
smallest id hash counts; a language without enough labelled rows, or null, has the overall threshold; texts of any length are trained on and scored whole,
one of over 65,536 words by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD_FOLD, column, field, freed, lent, map_texts, materialise, remove, share, ship_code, slices, texts_of, tidy

WIDTHS, FILTERS, DIMENSIONS, BUCKETS = (1, 2, 3), 8, 12, 1 << 16
#: Lengths in bytes of the word beginnings that are hashed beside the whole word.
BEGINNINGS = (4, 5, 6)
#: Texts of a shard, which one task trains on, and bytes of their words as buckets.
SHARD_ROWS, SHARD_BYTES = 8192, 48 << 20
#: One text in so many calibrates and is not trained on.
HELD_PART = 5
#: Steps of the logit in which calibration counts.
GRID = 1024
#: Embeddings that are averaged together.
BLOCK = 256
#: Bits of the map of labelled ids, as a power of two.
MAP_BITS = 26
THRESHOLD = 0.7
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 32, 0.01, 1e-4, 7
#: Hash buckets in fewer training texts than this count as unknown.
LEAST_TEXTS = 5
#: Labelled rows of a language, of each class, for a threshold of its own.
LEAST_OF_LANGUAGE = 40

_WORD_BYTE = np.frombuffer(WORD_FOLD, np.uint8)
_POWER = np.cumprod(np.full(256, 0x9E3779B97F4A7C15, np.uint64))


def word_buckets(texts: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word by feature, 1 to buckets - 1; first word of every text), with an unknown word, 0, before and after each text."""
    joined = np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8)
    folded = _WORD_BYTE[joined]
    inside = folded != 32
    edge = np.flatnonzero(np.diff(inside.view(np.int8)))
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    stop = np.cumsum(np.array([len(t) + 1 for t in texts]))  # text i lies before joined[stop[i]]
    owner = np.searchsorted(stop, starts, "left") if len(starts) else np.zeros(0, np.int64)
    size = ends - starts
    where = np.flatnonzero(inside)
    begin = np.cumsum(size) - size
    offset = np.arange(len(where)) - np.repeat(begin, size)
    value = (folded[where].astype(np.uint64) + np.uint64(1)) * _POWER[offset & 255]
    sums = np.cumsum(value, dtype=np.uint64)  # modulo 2**64, so differences are exact
    before = sums[begin] - value[begin] if len(size) else np.zeros(0, np.uint64)
    count = np.bincount(owner, minlength=len(texts)) + 2
    first = np.cumsum(count) - count
    out = np.zeros((1 + len(BEGINNINGS), int(count.sum())), np.int32)
    place = np.arange(len(size)) + 1 + 2 * owner
    for k, most in enumerate((None, *BEGINNINGS)):
        h = sums[begin + (size if most is None else np.minimum(size, most)) - 1] - before if len(size) else before
        h += np.uint64(k * 0x51ED270B)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        out[k, place] = (h % np.uint64(buckets - 1)).astype(np.int32) + 1
    return out, first


@dataclass
class Model:
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: place in the filter, dimension, filter
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float]
    fitted: bool = True

    def logits(self, texts: list[bytes]) -> np.ndarray:
        return self.logits_of(*word_buckets(texts))

    def logits_of(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        whole = np.concatenate([w for f in self.filters for w in f], 1)  # all places of all filters side by side
        tops = [np.full((len(first), FILTERS), -np.inf, np.float32) for _ in self.filters]
        for start, stop in _runs(first, ids.shape[1]):
            cut = slice(first[start], first[stop] if stop < len(first) else ids.shape[1])
            response = _embed(self.embedding, ids[:, cut]) @ whole
            at, begin = 0, first[start:stop] - first[start]
            for f, top in zip(self.filters, tops):
                places = [response[:, at + k * FILTERS : at + (k + 1) * FILTERS] for k in range(len(f))]
                at += len(f) * FILTERS
                top[start:stop] = np.maximum.reduceat(_slide(places, begin), begin)
        pooled = np.maximum(np.concatenate(tops, 1) + self.bias, 0)
        return pooled @ self.weight[:-1] + self.weight[-1] + self.offset

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted or not texts:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-np.clip(self.logits(texts).astype(np.float64), -60, 60)))


def _runs(first: np.ndarray, total: int, most: int = 1 << 16):
    """Ranges of texts of about `most` words, so that responses stay small; a longer text stands alone."""
    stop = np.append(first[1:], total)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(stop, first[i] + most, "right")))
        yield i, j
        i = j


def _embed(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = table[ids[0]]
    for more in ids[1:]:
        out += table[more]
    return out


def _slide(places: list[np.ndarray], first: np.ndarray) -> np.ndarray:
    """Responses by start. A text begins and ends with the unknown word, whose embedding is zero; starts that would reach further count as none."""
    out = places[0].copy()
    for k in range(1, len(places)):
        out[:-k] += places[k][k:]
    stop = np.append(first[1:], len(out))
    for k in range(1, len(places) - 1):
        out[np.maximum(stop - k, first)] = -1e9
    return out


def _begin(known: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters of `known` embeddings beside that of the unknown word, and zeroes for Adam's two means of each."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    p = {"E": rng.normal(0, 0.1, (known + 1, DIMENSIONS)).astype(np.float32)}
    p["E"][0] = 0
    for w in WIDTHS:
        p[f"W{w}"] = rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)).astype(np.float32)
    p["b"], p["v"] = np.zeros(n, np.float32), np.append(np.abs(rng.normal(0, 0.3, n)), 0).astype(np.float32)
    return p | {f"{m}.{k}": np.zeros_like(x) for m in ("m1", "m2") for k, x in p.items()}


def _pool(p: dict[str, np.ndarray], ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(largest responses by text, their places by width)."""
    pooled, where = [], []
    for start, stop in _runs(first, ids.shape[1]):
        begin = first[start]
        emb = _embed(p["E"], ids[:, begin : first[stop] if stop < len(first) else ids.shape[1]])
        inside = first[start:stop] - begin
        ends = np.append(inside[1:], len(emb))
        tops, places = [], []
        for w in WIDTHS:
            r = _slide([emb @ p[f"W{w}"][k] for k in range(w)], inside)
            best = np.stack([a + r[a:b].argmax(0) for a, b in zip(inside, ends)])
            tops.append(r[best, np.arange(FILTERS)])
            places.append(best + begin)
        pooled.append(np.concatenate(tops, 1))
        where.append(places)
    return np.concatenate(pooled), [np.concatenate(x) for x in zip(*where)]


def _epoch(p: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray, epoch: int, rng: np.random.Generator) -> None:
    """One pass of Adam on the logistic loss over texts, given as embeddings' numbers by feature and word."""
    order = rng.permutation(len(docs))
    step = epoch * -(-len(docs) // BATCH)
    names = ["E", *(f"W{w}" for w in WIDTHS), "b", "v"]
    for at in range(0, len(order), BATCH):
        batch = order[at : at + BATCH]
        ids = np.concatenate([docs[i] for i in batch], 1)
        size = np.array([docs[i].shape[1] for i in batch])
        pooled, where = _pool(p, ids, np.cumsum(size) - size)
        z = pooled + p["b"]
        a = np.maximum(z, 0)
        s = 1 / (1 + np.exp(-np.clip(a @ p["v"][:-1] + p["v"][-1], -60, 60)))
        d = (s - y[batch]).astype(np.float32) / len(batch)
        g = {"v": np.append(a.T @ d, d.sum())}
        dz = (d[:, None] * p["v"][:-1]) * (z > 0)
        g["b"] = dz.sum(0)
        touched, slopes = [], []
        for j, w in enumerate(WIDTHS):
            W = p[f"W{w}"]
            gw = np.zeros_like(W)
            c = dz[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(w):
                place = np.minimum(where[j] + k, ids.shape[1] - 1)
                gw[k] = np.einsum("bfd,bf->df", _embed(p["E"], ids[:, place.ravel()]).reshape(*place.shape, DIMENSIONS), c)
                touched.append(place.ravel())
                slopes.append((c[:, :, None] * W[k].T[None]).reshape(-1, DIMENSIONS))
            g[f"W{w}"] = gw
        g["E"] = np.zeros_like(p["E"])
        place, slope = np.concatenate(touched), np.concatenate(slopes)
        for feature in ids:
            np.add.at(g["E"], feature[place], slope)
        g["E"][0] = 0
        step += 1
        for k in names:
            grad, m1, m2 = g[k] + DECAY * p[k], p[f"m1.{k}"], p[f"m2.{k}"]
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad**2
            p[k] -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        p["E"][0] = 0


def _known(seen: np.ndarray, texts: int) -> np.ndarray:
    """Numbers of the embeddings by bucket; 0: unknown."""
    known = seen >= min(LEAST_TEXTS, 1 + texts // 20)
    known[0] = False
    return (np.cumsum(known) * known).astype(np.uint16)


def _model(p: dict[str, np.ndarray], number: np.ndarray) -> Model:
    return Model(p["E"][number], [p[f"W{w}"] for w in WIDTHS], p["b"], p["v"], 0.0, {})


def _unfitted() -> Model:
    return Model(np.zeros((1, 1)), [], np.zeros(0), np.zeros(0), 0.0, {}, False)


def fit(texts: list[bytes], labels: np.ndarray, languages: list[str | None], seed: int = SEED) -> Model:
    """A fit in memory, as one shard; every fifth of the distinct texts calibrates and is not trained on."""
    only = list({t: i for i, t in reversed(list(enumerate(texts)))}.values())[::-1]
    texts, languages = [texts[i] for i in only], [languages[i] for i in only]
    labels = np.asarray(labels, np.float32)[only]
    held = np.arange(len(texts)) % HELD_PART == HELD_PART - 1
    train = np.flatnonzero(~held)
    if len(train) < 2 or len(set(labels[train].tolist())) < 2:
        return _unfitted()
    docs = [word_buckets([texts[i]])[0] for i in train]
    seen = np.zeros(BUCKETS, np.int64)
    for d in docs:
        seen[np.unique(d)] += 1
    number = _known(seen, len(docs))
    docs = [number[d] for d in docs]
    p = _begin(int(number.max()), seed)
    for epoch in range(EPOCHS):
        _epoch(p, docs, labels[train], epoch, np.random.default_rng([seed, epoch, 0]))
    model = _model(p, number)
    check = np.flatnonzero(held) if len(set(labels[held].tolist())) == 2 else train
    logit = np.concatenate([model.logits([texts[i] for i in check[j : j + 50]]) for j in range(0, len(check), 50)])
    target = float(np.log(THRESHOLD / (1 - THRESHOLD)))
    model.offset = target - best_threshold(logit, labels[check])
    tongue = np.array([languages[i] or "" for i in check])
    for name in sorted(set(tongue.tolist()) - {""}):
        mine = tongue == name
        positive = int(labels[check][mine].sum())
        if min(positive, int(mine.sum()) - positive) >= LEAST_OF_LANGUAGE:
            model.thresholds[name] = _share_of(best_threshold(logit[mine], labels[check][mine]) + model.offset)
    return model


def _share_of(logit: float) -> float:
    return float(1 / (1 + np.exp(-logit)))


def best_threshold(logit: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the gap whose cut has the highest F1; among equals, of the widest gap."""
    values, at = np.unique(logit.astype(np.float64), return_inverse=True)
    return best_cut(values, np.bincount(at, labels, len(values)), np.bincount(at, minlength=len(values)))


def best_cut(values: np.ndarray, positive: np.ndarray, rows: np.ndarray) -> float:
    """`best_threshold` from counts by distinct value, ascending."""
    x, right, above = values[::-1], np.cumsum(positive[::-1]), np.cumsum(rows[::-1])
    if len(x) < 2:
        return 0.0
    f1 = 2 * right[:-1] / (above[:-1] + right[-1])
    gap = x[:-1] - x[1:]
    best = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = best[np.argmax(gap[best])]
    return float((x[k] + x[k + 1]) / 2)


def _hashed(rows: DataFrame) -> DataFrame:
    """The words of each text as buckets: 16-bit numbers, feature by feature."""
    ship_code(rows.sparkSession)
    schema = "h binary, y int, lang string, words binary"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, first = word_buckets(texts_of(part))
                cut = [x.astype("<u2").tobytes() for x in np.split(ids, first[1:], axis=1)]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in ("h", "y", "lang")), pa.array(cut, pa.binary())], names=["h", "y", "lang", "words"])
        tidy()

    return rows.mapInArrow(run, schema)


def _words_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").reshape(1 + len(BEGINNINGS), -1) for x in batch.column("words").to_pylist()]


def _texts_by_bucket(rows: DataFrame) -> np.ndarray:
    """In how many texts each bucket stands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for d in _words_of(batch):
                seen[np.unique(d)] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["bucket", "n"])

    seen = np.zeros(BUCKETS, np.int64)
    for r in rows.select("words").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        seen[r["bucket"]] = r["n"]
    return seen


def _averaged(rows: DataFrame, p: dict[str, np.ndarray], number: np.ndarray, epoch: int, seed: int) -> dict[str, np.ndarray]:
    """Parameters after one epoch: every shard of `rows` (sorted by shard) trains from `p`, in its task; the means, block by block, come back."""
    tables, others = [k for k in p if k.split(".")[-1] == "E"], [k for k in p if k.split(".")[-1] != "E"]
    names = ["block", "shard", "weight", "value"]

    def trained(shard: int, docs: list[np.ndarray], y: list[int]) -> Iterator[pa.RecordBatch]:
        start, number = shared.value
        mine = {k: x.copy() for k, x in start.items()}
        docs = [number[d] for d in docs]
        _epoch(mine, docs, np.array(y, np.float32), epoch, np.random.default_rng([seed, epoch, shard]))
        weight = np.zeros(len(mine["E"]), np.float32)
        for d in docs:
            weight[np.unique(d)] += 1
        table = np.concatenate([mine[k] for k in tables], 1)
        rest = np.concatenate([mine[k].ravel() for k in others])
        values = [table[at : at + BLOCK].tobytes() for at in range(0, len(table), BLOCK)] + [rest.tobytes()]
        weights = [weight[at : at + BLOCK].tobytes() for at in range(0, len(table), BLOCK)] + [np.float32(len(docs)).tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(values))), pa.array([shard] * len(values), pa.int64()), pa.array(weights, pa.binary()), pa.array(values, pa.binary())], names=names
        )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, docs, y = -1, [], []
        for batch in batches:
            of, label, words = batch.column("shard").to_pylist(), batch.column("y").to_pylist(), _words_of(batch)
            for s, c, d in zip(of, label, words):
                if s != shard and docs:
                    yield from trained(shard, docs, y)
                    docs, y = [], []
                shard = s
                docs.append(d)
                y.append(c)
        if docs:
            yield from trained(shard, docs, y)
        del docs
        tidy()

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("shard")
        total = weight = plain = 0.0
        for w, v in zip(table.column("weight").to_pylist(), table.column("value").to_pylist()):
            w, v = np.frombuffer(w, np.float32).astype(np.float64)[:, None], np.frombuffer(v, np.float32).astype(np.float64)
            v = v.reshape(len(w), -1)
            total, weight, plain = total + w * v, weight + w, plain + v / table.num_rows
        out = np.where(weight > 0, total / np.maximum(weight, 1), plain).astype(np.float32)
        return pa.table({"block": table.column("block")[:1], "value": pa.chunked_array([pa.array([out.tobytes()], pa.binary())])})

    with lent(rows.sparkSession, (p, number)) as shared, freed(rows.sparkSession):
        sent = rows.select("shard", "y", "words").mapInArrow(run, "block bigint, shard bigint, weight binary, value binary")
        means = sent.groupBy("block").applyInArrow(mean, "block bigint, value binary").collect()
    got = {r["block"]: np.frombuffer(r["value"], np.float32) for r in means}
    last = max(got)
    table = np.concatenate([got[b] for b in range(last)]).reshape(len(p["E"]), -1)
    out = {k: np.ascontiguousarray(x) for k, x in zip(tables, np.split(table, len(tables), axis=1))}
    ends = np.cumsum([p[k].size for k in others])[:-1]
    return {k: out[k] if k in out else None for k in p} | {k: x.reshape(p[k].shape).copy() for k, x in zip(others, np.split(got[last], ends))}


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Set the offset and the thresholds of languages by exact counts of rows by logit, in steps of 1/`GRID`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, "words"):
                words = _words_of(part)
                size = np.array([d.shape[1] for d in words])
                logit = m.logits_of(np.concatenate(words, 1), np.cumsum(size) - size)
                at = np.round(np.clip(logit.astype(np.float64), -60, 60) * GRID).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("lang"), part.column("y"), pa.array(at)], names=["lang", "y", "at"])
        tidy()

    least, grid = LEAST_OF_LANGUAGE, GRID

    def cut(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at, positive, n = (table.column(c).to_numpy() for c in ("at", "positive", "n"))
        name = table.column("lang")[:1]
        if min(positive.sum(), n.sum() - positive.sum()) < least:
            return pa.table({"lang": name[:0], "cut": pa.array([], pa.float64())})
        return pa.table({"lang": name, "cut": pa.array([best_cut(at / grid, positive, n)])})

    with lent(rows.sparkSession, model) as shared:
        counts = rows.select("lang", "y", "words").mapInArrow(run, "lang string, y int, at bigint").groupBy("lang", "at").agg(F.sum("y").alias("positive"), F.count("*").alias("n"))
        counts = counts.persist(StorageLevel.DISK_ONLY)
        got = counts.groupBy("at").agg(F.sum("positive").alias("positive"), F.sum("n").alias("n")).orderBy("at").collect()
        of_language = counts.where("lang is not null and lang <> ''").groupBy("lang").applyInArrow(cut, "lang string, cut double").collect()
        counts.unpersist()
    at, positive, n = (np.array([r[c] for r in got], np.float64) for c in ("at", "positive", "n"))
    model.offset = float(np.log(THRESHOLD / (1 - THRESHOLD))) - best_cut(at / GRID, positive, n)
    model.thresholds = {r["lang"]: _share_of(r["cut"] + model.offset) for r in sorted(of_language)}


def _likely(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows without most of those whose id is not in `marks`, by a map of hashed ids of at most 8 MB, so that their texts need no shuffle."""
    if rows.schema["id"].dataType != marks.schema["id"].dataType:
        return rows
    place = F.pmod(F.xxhash64("id"), F.lit(1 << MAP_BITS))
    bit = F.bitmap_bit_position(place)
    maps = marks.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("map"))
    byte = F.conv(F.hex(F.substr("map", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) > 0
    return rows.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(maps), "bucket").where(there).select(*rows.columns)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label: str = "toxic",
    shard_rows: int = SHARD_ROWS,
    shard_bytes: int = SHARD_BYTES,
    seed: int = SEED,
) -> Model:
    """Fit on all labelled rows, in shards of about `shard_rows` distinct texts and `shard_bytes` bytes of words (eight a word)."""
    marks = (
        labels.select(column(id_column).alias("id"), column(label).cast("int").alias("y"))
        .where("id is not null and y in (0, 1)")
        .groupBy("id")
        .agg(F.max("y").alias("y"))
    )
    rows = docs.select(
        column(id_column).alias("id"),
        F.coalesce(column(text).cast("binary"), F.lit(b"")).alias("text"),
        (column(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")).alias("lang"),
    )
    rows = _likely(rows, marks).join(marks, "id")
    one = F.min(F.struct(F.xxhash64(F.col("id").cast("string")).alias("order"), "id", "y", "lang", "text")).alias("one")
    distinct = rows.groupBy(F.unhex(F.md5("text")).alias("h")).agg(one).select("h", "one.y", "one.lang", "one.text")
    stored = materialise(_hashed(distinct), "toxicity-words")
    hashed = F.xxhash64("h")
    held = F.pmod(hashed, F.lit(HELD_PART)) == 0
    size = {(r["held"], r["y"]): (r["n"], r["bytes"]) for r in stored.groupBy(held.alias("held"), "y").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes")).collect()}
    if not {(False, 0), (False, 1)} <= size.keys():
        remove(stored)
        return _unfitted()
    texts, total = (sum(x[k] for (h, _), x in size.items() if not h) for k in (0, 1))
    shards = max(-(-texts // shard_rows), -(-total // shard_bytes))
    placed = stored.where(~held).select(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(shards)).alias("shard"), "h", "y", "words")
    placed = placed.repartition(shards, "shard").sortWithinPartitions("shard", "h")
    fitted = stored.where(~held)
    number = _known(_texts_by_bucket(fitted), texts)
    p = _begin(int(number.max()), seed)
    for epoch in range(EPOCHS):
        p = _averaged(placed, p, number, epoch, seed)
    model = _model(p, number)
    _calibrate(model, stored.where(held) if {(True, 0), (True, 1)} <= size.keys() else fitted)
    remove(stored)
    return model


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` and `toxicity`, 0 to 1, from whole texts."""
    shared = share(docs.sparkSession, model)

    def make():
        m = shared.value
        return lambda texts: [pa.array(m.scores(texts), pa.float64())]

    return map_texts(docs, keep, [field("toxicity", "double")], make, text)


def threshold_of(model: Model, lang):
    """The decision threshold for a language column."""
    out = F.lit(THRESHOLD)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(lang == name, F.lit(value)).otherwise(out)
    return out
