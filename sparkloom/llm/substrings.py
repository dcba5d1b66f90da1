"""Exact substring dedup: every byte under a string of `LENGTH` bytes that also starts earlier is removed.

Anchors make the work local. A document's 32-byte grams are hashed; a gram is an anchor if it is the smallest of
some window of `LENGTH` bytes, which depends on that window's bytes alone. Two equal windows hence have
the same anchors at the same places, and meet at the anchor's hash. An anchor's context is all the text that its
windows reach.

1. Anchors with equal context (128-bit identifiers): all but the first are removed with their contexts, no text needed. Copies
   within a slice are folded before the shuffle, so a hot passage sends one row a slice; sorted anchors stream through a task.
2. Anchors with several contexts: the first of each context sends its bytes. In a task, a suffix array by
   bucket-pointer refinement sorts all windows: suffixes stand in buckets of equal grams of 8 bytes, numbered in order; a bucket is
   refined by sorting its members on the buckets of the suffixes that many bytes on, and the refined numbers are the keys of the
   next, twice as deep, round, up to 100 bytes. Suffixes alone in their bucket are settled. Equal buckets are equal bytes.
   All but the first window of a bucket are removed. The windows of an anchor of very many contexts are dealt out by the
   identifiers of their grams 0, 32, 64 and 68 bytes on, 128 bits in all, the last refinement first, so that no task needs
   a whole hot group.

Removed windows become intervals, merged by document, and are cut out of the text.

Defined results: null and empty texts have no bytes; rows with null doc_id have none removed and no say; rows of one doc_id
and one text are repeats, none an earlier start of the other, and get the same result; rows of one doc_id with different texts are
documents of their own, in order of a hash of the text; texts of any length go through in overlapping stretches of a MB; an empty table
gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import column, field, materialise, partitions, ship_code, slices, texts_of, tidy

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM  # bytes that a window can reach before its anchor's gram
WIDTH = SPAN + LENGTH
#: Contexts refined at once; about 2 kB of memory for each.
CHUNK = 4_000
#: Contexts of one anchor beyond which its windows are dealt out by their content.
HOT = 20_000
#: Such anchors at most: with more contexts in all, the limit grows.
MOST_HOT = 100_000
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 257, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_MOST = np.uint64(2**64 - 1)
#: Bytes of a text that are searched for anchors at once, and what each stretch sees of its neighbours.
STRETCH, MARGIN = 1 << 20, 2 * LENGTH
#: Bytes of the first grams of the refinement: they fit a whole number.
FIRST = 8


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def _grams(values: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all grams of `width`, a power of two, along the last axis."""
    h, power, w = values, _POWER, 1
    while w < width:
        h = h[..., :-w] * np.uint64(power) + h[..., w:]
        power, w = power * power % 2**64, w * 2
    return _mixed(h)


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of x[i : i + width], by block prefixes and suffixes."""
    pick, pad = (np.minimum, _MOST) if least else (np.maximum, np.uint64(0))
    n = len(x) - width + 1
    padded = np.concatenate([x, np.full(-len(x) % width, pad)]).reshape(-1, width)
    ahead = pick.accumulate(padded, 1).ravel()
    back = pick.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    return pick(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, place, gram hash, context hash, second context hash) of all anchors."""
    parts = []
    short = [i for i, t in enumerate(texts) if len(t) <= STRETCH]
    text, *rest = _anchors([texts[i] for i in short])
    parts.append((np.array(short, np.int64)[text], *rest))
    for i, t in enumerate(texts):
        for at in range(0, len(t), STRETCH) if len(t) > STRETCH else ():
            low = max(0, at - MARGIN)
            _, place, *rest = _anchors([t[low : at + STRETCH + MARGIN]])
            mine = (place + low >= at) & (place + low < at + STRETCH)
            parts.append((np.full(int(mine.sum()), i), place[mine] + low, *(x[mine] for x in rest)))
    return tuple(map(np.concatenate, zip(*parts)))


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    joined = b"".join(texts)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    if len(joined) < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    values = _TABLE[np.frombuffer(joined, np.uint8)]
    gram = _grams(values, GRAM)
    ends = np.cumsum(size)
    begin = ends - size
    window = _sliding(gram, SPAN + 1, True)
    place = np.arange(len(joined), dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), size)
    left = place - begin[owner]
    right = ends[owner] - place
    window = np.where(right[: len(window)] >= LENGTH, window, np.uint64(0))  # windows across two texts choose nothing
    best = _sliding(np.concatenate([np.zeros(SPAN, np.uint64), window, np.zeros(SPAN, np.uint64)]), SPAN + 1, False)[: len(gram)]
    at = np.flatnonzero((gram == best) & (right[: len(gram)] >= GRAM))
    # a gram equal to the best of a window that only touches it from the next text is no anchor: its own windows decide
    lead, tail = np.minimum(left[at], SPAN), np.minimum(right[at], LENGTH)
    shape = (lead * 512 + tail).astype(np.uint64) * np.uint64(_POWER)
    contexts = []
    for odd in _ODD:  # two identifiers of the context's bytes, from sums of the text so far
        up, down = _series(odd, len(values)), _series(pow(odd, -1, 2**64), len(values))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up, dtype=np.uint64)])
        contexts.append(_mixed(((sums[at + tail] - sums[at - lead]) * down[at - lead]) ^ shape))
    return owner[at], left[at], gram[at], *contexts


_ODD = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_cache: dict[int, np.ndarray] = {}


def _series(base: int, n: int) -> np.ndarray:
    """Powers of the base; as many as a slice needs are kept."""
    most = 2 * STRETCH
    if base not in _cache:
        _cache[base] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(most, base, np.uint64)]), dtype=np.uint64)
    have = _cache[base]
    return have[:n] if n <= most else np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]), dtype=np.uint64)[:n]


_ANCHOR = "gram bigint, context bigint, context2 bigint, doc bigint, th bigint, place bigint, lead int, tail int, gone boolean"
_KEYS = ("gram", "context", "context2")


def _anchor_rows(batches):
    """Anchors, first of each context in its slice; the others leave as removed intervals (`gone`)."""
    for batch in batches:
        for part in slices(batch, "text"):
            ids, th = (part.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "th"))
            texts = texts_of(part)
            order = np.lexsort((th, ids))
            ids, th, texts = ids[order], th[order], [texts[i] for i in order]
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            text, place, gram, context, context2 = anchors(texts)
            doc, th = ids[text], th[text]
            lead, tail = np.minimum(place, SPAN), np.minimum(size[text] - place, LENGTH)
            sort = np.lexsort((place, th, doc, context2, context, gram))
            columns = {"gram": gram.view(np.int64), "context": context.view(np.int64), "context2": context2.view(np.int64), "doc": doc, "th": th, "place": place}
            columns = {k: v[sort] for k, v in columns.items()}
            new, own = _heads(columns)
            yield _batch(~own | new, **columns, lead=lead[sort].astype(np.int32), tail=tail[sort].astype(np.int32), gone=~new)
    tidy()


def _heads(c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted anchors: which are the first of their context, and which are at the very place of that first one."""
    new = np.ones(len(c["gram"]), bool)
    new[1:] = np.any([c[k][1:] != c[k][:-1] for k in _KEYS], 0)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return new, np.all([c[k] == c[k][head] for k in ("doc", "th", "place")], 0)


def _batch(keep: np.ndarray, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns.values()], names=list(columns))


def _table(batches) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got) if got else None


_TASK = "doc bigint, th bigint, start bigint, stop bigint, gram bigint"


def _first_contexts(batches):
    """Sorted by gram, contexts, doc, th, place. Removed contexts as intervals; what needs its text as (place, gram).

    Between batches only the last context's first anchor is carried, and whether its gram has had another context."""
    head: dict | None = None  # the first anchor of the latest context
    several = False  # whether the latest gram has more than one context
    names = [*_KEYS, "doc", "th", "place", "lead", "tail", "gone"]
    for batch in batches:
        if not batch.num_rows:
            continue
        c = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
        passed = c.pop("gone")  # settled in its slice
        out = [tuple(c[k][passed] for k in ("doc", "th", "place", "lead", "tail", "gram"))]
        c = {k: v[~passed] for k, v in c.items()}
        if len(c["gram"]):
            if head is not None:
                c = {k: np.concatenate([[head[k]], v]) for k, v in c.items()}
            new, own = _heads(c)
            gone = ~new & ~own
            out.append(tuple(c[k][gone] for k in ("doc", "th", "place", "lead", "tail", "gram")))
            at = np.flatnonzero(new)
            gram = c["gram"][at]
            first = np.append(True, gram[1:] != gram[:-1])
            group = np.cumsum(first) - 1
            many = np.bincount(group) > 1
            asked_before = head is not None and several  # then the carried head has been asked for already
            many[0] |= asked_before
            ask = many[group]
            if asked_before:
                ask[0] = False
            # the latest context is carried: it is asked for now if its gram has others, else once there is another
            several = bool(many[-1])
            ask_at = at[ask]
            head = {k: v[at[-1]] for k, v in c.items()}
        else:
            ask_at = np.zeros(0, np.int64)
        doc, th, place, lead, tail, gram = (np.concatenate(x) for x in zip(*out))
        n = len(ask_at)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([doc, c["doc"][ask_at]])),
                pa.array(np.concatenate([th, c["th"][ask_at]])),
                pa.array(np.concatenate([place - lead, c["place"][ask_at]])),
                pa.array(np.concatenate([place + tail, np.full(n, -1)])),
                pa.array(np.concatenate([gram, c["gram"][ask_at]])),
            ],
            names=["doc", "th", "start", "stop", "gram"],
        )
    tidy()


def _contexts(batches):
    """The bytes around the asked anchors of each document: gram, hot, doc, th, place, lead, context."""
    for batch in batches:
        for part in slices(batch, "text"):
            out: list[tuple] = []
            docs, ths = (part.column(c).to_pylist() for c in ("doc", "th"))
            for doc, th, text, asked in zip(docs, ths, texts_of(part), part.column("asked").to_pylist()):
                for x in asked:
                    p = x["start"]
                    out.append((x["gram"], x["hot"], doc, th, p, min(p, SPAN), text[max(0, p - SPAN) : p + LENGTH]))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["gram", "hot", "doc", "th", "place", "lead", "context"]
            )
    tidy()


def _matrix(contexts: list[bytes], lead: np.ndarray) -> np.ndarray:
    """Contexts with their anchors in one column; 0 where there is no text."""
    out = np.zeros((len(contexts), WIDTH), np.uint8)
    size = np.fromiter(map(len, contexts), np.int64, len(contexts))
    flat = np.frombuffer(b"".join(contexts), np.uint8)
    row = np.repeat(np.arange(len(contexts)), size)
    column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(SPAN - lead, size)
    out[row, column] = flat
    return out


def window_buckets(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, bucket) of the windows that share their bucket, by bucket-pointer refinement. Equal buckets are equal bytes.

    Suffixes stand first in buckets of equal grams of `FIRST` bytes, numbered in order. A round sorts the members of shared buckets by
    (own bucket, bucket of the suffix `depth` bytes on); the refined numbers serve the next round, of twice the depth. Suffixes
    alone in their bucket are settled: they drop out, and windows that begin with one are nobody's equal.
    """
    m, width = matrix.shape
    depth, columns = FIRST, width - FIRST + 1
    gram = np.zeros((m, columns), np.uint64)
    for k in range(FIRST):  # bytes with 0 for no text: what reaches past a text's end is ruled out by the caller
        gram = (gram << np.uint64(8)) | matrix[:, k : k + columns].astype(np.uint64)
    order = np.argsort(gram.ravel(), kind="stable")
    ordered = gram.ravel()[order]
    pointer = np.empty(m * columns, np.int64)
    pointer[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
    pointer = pointer.reshape(m, columns)
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        columns = width - (depth + step) + 1
        size = np.bincount(pointer.ravel())
        here = pointer[:, :columns]
        row, col = np.nonzero(size[here] > 1)  # shared buckets only
        own, ahead = here[row, col], pointer[row, col + step]
        key = own * (int(pointer.max()) + 1) + ahead
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        refined = np.empty(len(key), np.int64)
        refined[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])) if len(key) else 0
        # settled suffixes keep numbers of their own, so that buckets stay apart
        after = np.arange(m * columns, dtype=np.int64).reshape(m, columns) + (int(refined.max()) + 1 if len(key) else 0)
        after[row, col] = refined
        pointer, depth = after, depth + step
        shared = (row, col, refined)
    row, col, bucket = shared
    again = np.bincount(bucket)[bucket] > 1 if len(bucket) else np.zeros(0, bool)
    return row[again], col[again], bucket[again]


def _refine(batches):
    """Sorted by gram, doc, th, place. Intervals of windows whose bucket has an earlier one."""

    def judge(table: pa.Table):
        doc, th, place, lead = (table.column(c).to_numpy() for c in ("doc", "th", "place", "lead"))
        gram = table.column("gram").to_numpy()
        contexts = table.column("context").to_pylist()
        size = np.fromiter(map(len, contexts), np.int64, len(contexts))
        row, col, bucket = window_buckets(_matrix(contexts, lead))
        ok = (col >= SPAN - lead[row]) & (col + LENGTH <= SPAN - lead[row] + size[row])
        row, col, bucket = row[ok], col[ok], bucket[ok]
        start = place[row] - SPAN + col
        order = np.lexsort((start, th[row], doc[row], bucket, gram[row]))
        row, col, start, bucket = row[order], col[order], start[order], bucket[order]
        new = np.ones(len(row), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (gram[row[1:]] != gram[row[:-1]])
        head = np.maximum.accumulate(np.where(new, np.arange(len(row)), 0))
        later = (doc[row] != doc[row[head]]) | (th[row] != th[row[head]]) | (start != start[head])
        flag = np.zeros((len(contexts), SPAN + 3), bool)
        flag[row[later], col[later] + 1] = True
        turn = np.argwhere(flag[:, 1:] != flag[:, :-1])
        r, a, b = turn[::2, 0], turn[::2, 1], turn[1::2, 1]
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[r]), pa.array(th[r]), pa.array(place[r] - SPAN + a), pa.array(place[r] - SPAN + b - 1 + LENGTH)],
            names=["doc", "th", "start", "stop"],
        )

    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            waiting.append(batch.slice(at, CHUNK))
            size += waiting[-1].num_rows
            if size >= CHUNK:
                table = pa.Table.from_batches(waiting).combine_chunks()
                gram = table.column("gram").to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))
                if cut:
                    yield judge(table.slice(0, cut).combine_chunks())
                    waiting = table.slice(cut).combine_chunks().to_batches()
                    size = sum(b.num_rows for b in waiting)
    table = _table(waiting)
    if table is not None:
        yield judge(table.combine_chunks())
    tidy()


def _by_content(batches):
    """For hot anchors: each window under the identifiers of its grams, (key, key2, doc, th, start)."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            doc, th, place, lead = (part.column(c).to_numpy() for c in ("doc", "th", "place", "lead"))
            contexts = part.column("context").to_pylist()
            size = np.fromiter(map(len, contexts), np.int64, len(contexts))
            pointer = _grams(_TABLE[_matrix(contexts, lead)], GRAM)
            n = SPAN + 1
            key = pointer[:, :n]
            key2 = key * _MIX
            for step in (GRAM, 2 * GRAM, LENGTH - GRAM):
                ahead = pointer[:, step : step + n]
                key = _mixed(key * np.uint64(_POWER) + ahead)
                key2 = _mixed((key2 ^ ahead) * np.uint64(_ODD[1]))
            col = np.arange(n)[None]
            row, col = np.nonzero((col >= SPAN - lead[:, None]) & (col + LENGTH <= (SPAN - lead + size)[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[row, col].view(np.int64)), pa.array(key2[row, col].view(np.int64)), pa.array(doc[row]), pa.array(th[row]), pa.array(place[row] - SPAN + col)],
                names=["key", "key2", "doc", "th", "start"],
            )
    tidy()


def removed_spans(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, spans): byte intervals to remove, for documents that have any; th tells texts of one doc apart."""
    spark = docs.sparkSession
    ship_code(spark)
    parts = partitions(spark)
    source = docs.where(column(id_column).isNotNull() & column(text).isNotNull()).select(
        column(id_column).cast("bigint").alias("doc"), F.xxhash64(column(text)).alias("th"), column(text).cast("binary").alias("text")
    )
    found = source.mapInArrow(_anchor_rows, _ANCHOR)
    # intervals settled in their slice ride along under a key of their own, dealt out evenly
    dealt = found.repartition(parts, F.when(F.col("gone"), F.xxhash64("doc", "place")).otherwise(F.col("gram")))
    tasks = materialise(
        dealt.sortWithinPartitions("gram", "context", "context2", "doc", "th", "place").mapInArrow(_first_contexts, _TASK), "anchors"
    )
    wanted = tasks.where("stop < 0")
    # at most MOST_HOT grams can be that hot, so they are broadcast, and what asks stays where it is
    most = max(HOT, -(-wanted.count() // MOST_HOT))
    hot_grams = wanted.groupBy("gram").count().where(F.col("count") > most).select("gram", F.lit(True).alias("hot"))
    wanted = wanted.join(F.broadcast(hot_grams), "gram", "left").select("doc", "th", "start", "gram", F.coalesce("hot", F.lit(False)).alias("hot"))
    asked = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "gram", "hot")).alias("asked"))
    contexts = source.join(asked, ["doc", "th"]).mapInArrow(
        _contexts, "gram bigint, hot boolean, doc bigint, th bigint, place bigint, lead int, context binary"
    )
    contexts = materialise(contexts, "contexts")
    plain = (
        contexts.where("not hot")
        .repartition(parts, "gram")
        .sortWithinPartitions("gram", "doc", "th", "place")
        .mapInArrow(_refine, "doc bigint, th bigint, start bigint, stop bigint")
    )
    windows = contexts.where("hot").mapInArrow(_by_content, "key bigint, key2 bigint, doc bigint, th bigint, start bigint")
    heads = windows.groupBy("key", "key2").agg(F.min(F.struct("doc", "th", "start")).alias("head"))
    hot = (
        windows.join(heads, ["key", "key2"])
        .where("struct(doc, th, start) <> head")
        .select("doc", "th", "start", (F.col("start") + LENGTH).alias("stop"))
        .distinct()
    )
    every = tasks.where("stop >= 0").select("doc", "th", "start", "stop").unionByName(plain).unionByName(hot)
    return every.groupBy("doc", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _merge(spans: list[dict] | None, size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def dedup_substrings(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: n_bytes, the removed `spans` as byte intervals, n_removed, and `kept`, the bytes that stay (they may part a character)."""
    spans = removed_spans(docs, id_column, text)
    rows = docs.select(
        column(id_column).alias("id"), column(id_column).cast("bigint").alias("doc"), F.xxhash64(column(text)).alias("th"), column(text).cast("binary").alias("text")
    ).join(spans, ["doc", "th"], "left")
    schema = T.StructType(
        [docs.schema[id_column], field("n_bytes", "bigint"), field("n_removed", "bigint"), field("spans", "array<struct<start:bigint,stop:bigint>>"), field("kept", "binary")]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part)
                merged = [_merge(s, len(t)) for s, t in zip(part.column("spans").to_pylist(), texts)]
                kept = []
                for t, cut in zip(texts, merged):
                    edge = [0, *(x for c in cut for x in c), len(t)]
                    kept.append(b"".join(t[a:b] for a, b in zip(edge[::2], edge[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([len(t) for t in texts], pa.int64()),
                        pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                        pa.array([[{"start": a, "stop": b} for a, b in c] for c in merged], kind),
                        pa.array(kept, pa.binary()),
                    ],
                    names=schema.names,
                )

    return rows.select("id", "text", "spans").mapInArrow(run, schema)


def brute(texts: dict[int, bytes], length: int = LENGTH) -> dict[int, bytes]:
    """The definition, spelled out; for small inputs."""
    seen: set[bytes] = set()
    out = {}
    for doc in sorted(texts):
        t = texts[doc]
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        out[doc] = bytes(c for c, g in zip(t, gone) if not g)
    return out
