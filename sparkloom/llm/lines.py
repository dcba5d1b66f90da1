"""Fuzzy line dedup: MinHash over character shingles, banding, exact Jaccard, distributed union-find.

A line is what stands between line feeds, without surrounding ASCII white space; blank lines are layout and
always stay. Lines are alike when the sets of their 8-character shingles (a shorter line is one shingle) have a
Jaccard similarity of 0.8 or more. Of each component of alike lines the first stays, by doc_id, then line number; all
others are removed, wherever they stand.

Exact copies are folded first, in slices of texts, then by an aggregate over 128-bit hashes. Three minima form a band and eight
bands a signature: a pair at similarity 0.8 shares a band with probability 0.997, at 0.9 with 0.99997. Band keys are dealt in buckets,
many to a row, and a task puts one bucket in order at a time, 20 bytes a key; a group of over `TILE` distinct lines leaves as tiles,
whose pairs are dealt out by a join, so that no line is left out and no task holds the texts of a whole hot group. Lines that share
a band are compared exactly: a bit sketch of each shingle set bounds the overlap from above and rules out most pairs, the rest count
common shingles. Groups of one smallest member are compared in one place, where lines found alike once are not compared again.

Defined results: null texts stay null and empty ones empty; rows with null doc_id stay as they are and have no say;
rows of one doc_id and one text get the same result; rows of one doc_id with different texts are documents of their own, in
order of a hash of the text; lines and texts may be of any length; an empty table gives none. Columns of docs named n_lines
or n_removed are replaced by the results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import as_bytes, column, field, kept_field, materialise, packed, partitions, ship_code, slices, texts_of, tidy, unpacked
from sparkloom.llm.components import components, spanning, union

SHINGLE, ROWS, BANDS = 8, 3, 8
#: Similarity of 4/5, as whole numbers.
ALIKE = (4, 5)
#: Lines of a tile, and their bytes; a longer line makes a tile of its own.
TILE, TILE_BYTES = 1024, 1 << 20
#: Band keys dealt at once, and buckets of keys for each partition.
DEAL, BUCKETS = 1 << 19, 8
#: Bytes of lines whose groups are compared at once, so that their shingles stay in a cache; a larger group stands alone.
STRETCH = 1 << 17
#: Bits of a sketch, at least; slices of longer lines have more.
SKETCH = 256
#: Shingles of two lines from which they are counted by themselves.
PAIR = 128
_BLANKS = b" \t\r\x0b\x0c"
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_RNG = np.random.default_rng(20)
_A = (_RNG.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)


def lines_of(text: bytes) -> list[bytes]:
    return [x.strip(_BLANKS) for x in text.split(b"\n")]


def line_hashes(lines: list[bytes]) -> np.ndarray:
    """Signed 128-bit hashes, in two columns."""
    import xxhash

    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), np.int64).reshape(-1, 2)


def shingles(line: bytes) -> set[str]:
    text = line.decode("utf-8", "replace")
    return {text[i : i + SHINGLE] for i in range(max(1, len(text) - SHINGLE + 1))}


def alike(a: set[str], b: set[str]) -> bool:
    both = len(a & b)
    return both * ALIKE[1] >= ALIKE[0] * (len(a) + len(b) - both)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """Signed 64-bit keys, a row for each line and a column for each band."""
    out = np.zeros((len(lines), BANDS), np.uint64)
    step = 1 << 15  # numbers of so many letters stay in a cache
    at, total = 0, 0
    sizes = [len(x) for x in lines]
    for i, n in enumerate(sizes):
        total += n
        if total > step or i + 1 == len(lines):
            out[at : i + 1] = _some_keys(lines[at : i + 1])
            at, total = i + 1, 0
    return out.view(np.int64)


def _some_keys(lines: list[bytes]) -> np.ndarray:
    texts = [x.ljust(SHINGLE, b"\0") for x in lines]
    whole = b"".join(texts)
    if whole.isascii():
        points = np.frombuffer(whole, np.uint8).astype(np.uint64)
    else:
        texts = [x.decode("utf-8", "replace").ljust(SHINGLE, "\0") for x in lines]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    count = size - SHINGLE + 1
    h, power, width = points * _MIX, 0x9E3779B97F4A7C15, 1
    while width < SHINGLE:  # hashes of twice the width from those before
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % 2**64, width * 2
    h ^= h >> np.uint64(32)
    h *= _MIX
    inside = np.ones(len(points), bool)
    ends = np.cumsum(size)
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    x = (h[inside[: len(h)]] >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(count) - count
    out = np.zeros((len(lines), BANDS), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(BANDS):
            key = np.full(len(lines), np.uint64(band + 1))
            for p in range(band * ROWS, (band + 1) * ROWS):
                low = np.minimum.reduceat(x * _A[p] + _B[p], starts)
                key = (key ^ low) * _MIX
                key ^= key >> np.uint64(30)
            out[:, band] = key
    return out


def _source(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc, th, text) of rows that have a say; th tells texts of one doc apart."""
    have = docs.where(column(id_column).isNotNull() & column(text).isNotNull())
    return have.select(
        column(id_column).cast("bigint").alias("doc"), F.xxhash64(column(text)).alias("th"), column(text).cast("binary").alias("text")
    )


def _locate(batches):
    """(h, h2, doc, th, line) of lines that are not blank, each where it first stands in a slice."""
    for batch in batches:
        for part in slices(batch, "text"):
            lines = [lines_of(t) for t in texts_of(part)]
            count = np.array([len(x) for x in lines])
            flat = [y for x in lines for y in x]
            h = line_hashes(flat)
            number = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
            full = np.fromiter(map(bool, flat), bool, len(flat))
            doc, th = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), count)[full] for c in ("doc", "th"))
            h, number = h[full], number[full].astype(np.int32)
            order = np.lexsort((number, th, doc, h[:, 1], h[:, 0]))
            mine = h[order]
            order = order[np.append(True, (mine[1:] != mine[:-1]).any(1))[: len(order)]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[order]) for x in (h[:, 0], h[:, 1], doc, th, number)], names=["h", "h2", "doc", "th", "line"]
            )
    tidy()


_DEALT = "bucket int, key array<bigint>, h array<bigint>, size array<int>"


def _bands(buckets: int):
    """Keys, h and size of lines, each line once a slice, as one row for each bucket: a range of keys."""

    def run(batches):
        held, total = [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                only = list({y for t in texts_of(part) for y in lines_of(t)} - {b""})
                if not only:
                    continue
                size = np.minimum(np.fromiter(map(len, only), np.int64, len(only)), 2**31 - 1).astype(np.int32)
                held.append((band_keys(only).ravel(), np.repeat(line_hashes(only)[:, 0], BANDS), np.repeat(size, BANDS)))
                total += BANDS * len(only)
                if total >= DEAL:
                    yield _in_buckets(held, buckets)
                    held, total = [], 0
        if held:
            yield _in_buckets(held, buckets)
        tidy()

    return run


def _in_buckets(held: list[tuple[np.ndarray, ...]], buckets: int) -> pa.RecordBatch:
    key, h, size = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key)
    high = (key[order].view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
    bucket = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    edge = pa.array(np.append(start, len(bucket)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(edge, pa.array(x[order])) for x in (key, h, size)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[start]), *lists], names=["bucket", "key", "h", "size"])


def _shared(batches):
    """By bucket: (key, h, size), in order of the keys, without the keys that stand alone. Numbers of one bucket are held, no texts."""
    held: list[list[np.ndarray]] = []
    now = None
    for batch in batches:
        bucket = batch.column("bucket").to_numpy()
        edge = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
        for a, b in zip(edge, edge[1:]):
            if held and bucket[a] != now:
                yield _repeated(held)
                held = []
            now = bucket[a]
            held.append([batch.column(c).slice(a, b - a).flatten().to_numpy() for c in ("key", "h", "size")])
    if held:
        yield _repeated(held)


def _repeated(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    key, h, size = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    more = np.append(False, same) | np.append(same, False)
    order = order[more]
    return pa.RecordBatch.from_arrays([pa.array(key[more]), pa.array(h[order]), pa.array(size[order])], names=["key", "h", "size"])


def _band_groups(batches):
    yield from _groups(_shared(batches))


_GROUP = "g bigint, g2 bigint, tile int, h array<bigint>"


def _groups(batches):
    """Sorted by key: distinct lines that share a band, as whole groups (tile -1), named by their members, or as tiles of one."""
    held: np.ndarray | None = None  # rows of the last group, which may go on: key, h, size
    sent = 0  # tiles of that group that have left
    for batch in _and_end(batches):
        rows = held
        if batch is not None:
            new = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "h", "size")], 1)
            rows = new if held is None else np.concatenate([held, new])
        if rows is None or not len(rows):
            continue
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        first = np.ones(len(rows), bool)
        first[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
        rows = rows[first]
        start = np.flatnonzero(np.append(True, rows[1:, 0] != rows[:-1, 0]))
        edge = np.append(start, len(rows))
        count, size = np.diff(edge), np.add.reduceat(rows[:, 2], start)
        last = len(start) - 1
        small = (count > 1) & (count <= TILE) & (size <= TILE_BYTES)
        small[0] &= not sent
        large = (count > 1) & ~small
        large[0] |= bool(sent)
        tiles: list[tuple[int, np.ndarray]] = []
        held = None
        if batch is not None:  # the last group waits for more
            small[last] = large[last] = False
        for i in np.flatnonzero(large).tolist():
            mine = rows[edge[i] : edge[i + 1]]
            cuts = _cuts(mine[:, 2])
            tiles += [((sent if i == 0 else 0) + t, mine[a:b]) for t, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        if batch is not None:
            mine = rows[edge[last] :]
            cuts = _cuts(mine[:, 2]) if count[last] > TILE or size[last] > TILE_BYTES else [0, len(mine)]
            before = sent if last == 0 else 0
            tiles += [(before + t, mine[a:b]) for t, (a, b) in enumerate(zip(cuts, cuts[1:-1]))]
            sent, held = before + len(cuts) - 2, mine[cuts[-2] :]
        if small.any() or tiles:
            yield _sets(rows[np.repeat(small, count)], count[small], tiles)
    tidy()


def _and_end(batches):
    yield from batches
    yield None


def _cuts(size: np.ndarray) -> list[int]:
    """Edges of tiles."""
    out, total = [0], 0
    for i, n in enumerate(size.tolist()):
        if i > out[-1] and (i - out[-1] >= TILE or total + n > TILE_BYTES):
            out.append(i)
            total = 0
        total += n
    return [*out, len(size)]


def _sets(rows: np.ndarray, count: np.ndarray, tiles: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    flat = np.concatenate([rows, *(t for _, t in tiles)])
    sizes = np.concatenate([count, np.array([len(t) for _, t in tiles], np.int64)])
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    both = np.ascontiguousarray(flat[:, 1]).view(np.uint64)
    names = []
    for shift in (29, 31):  # a set is named by its members, whatever band it came from
        mixed = (both ^ (both >> np.uint64(shift))) * _MIX
        names.append(np.add.reduceat(mixed ^ (mixed >> np.uint64(shift)), ends[:-1]).view(np.int64).copy())
    tile = np.full(len(sizes), -1, np.int32)
    for i, (t, mine) in enumerate(tiles, len(count)):
        tile[i] = t
        names[0][i] = names[1][i] = mine[0, 0]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names[0]),
            pa.array(names[1]),
            pa.array(tile),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(both.view(np.int64))),
        ],
        names=["g", "g2", "tile", "h"],
    )


class Shingles:
    """Distinct shingles of many lines, as numbers, line after line; equal numbers are equal shingles."""

    def __init__(self, lines: list[bytes]):
        texts = [x.decode("utf-8", "replace").ljust(SHINGLE, "\0") for x in lines]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        most = int(points.max()) if len(points) else 0
        if most < 128:
            code, bits = points.astype(np.uint64), 7
        else:  # numbered densely, so that few bits hold a letter
            letters = np.zeros(most + 1, bool)
            letters[points] = True
            code = (np.cumsum(letters) - 1).astype(np.uint64)[points]
            bits = max(1, int(letters.sum() - 1).bit_length())
        inside = np.ones(len(points), bool)
        ends = np.cumsum(size)
        for k in range(1, SHINGLE):
            inside[ends - k] = False
        at = np.flatnonzero(inside)
        owner = np.repeat(np.arange(len(lines)), size - SHINGLE + 1)
        if SHINGLE * bits < 64:  # a shingle's letters fit a number, beside some bits for the line
            width, word = 1, code
            while width < SHINGLE:  # numbers of twice the letters from those before
                word = (word[:-width] << np.uint64(width * bits)) | word[width:]
                width *= 2
            number, self.bits = word[at], SHINGLE * bits
        else:
            each, number = 64 // bits, np.zeros(len(at), np.int64)
            for first in range(0, SHINGLE, each):  # the letters of a shingle, as many as fit a word, then numbered anew
                word = np.zeros(len(at), np.uint64)
                for k in range(first, min(SHINGLE, first + each)):
                    word = (word << np.uint64(bits)) | code[at + k]
                found, mine = np.unique(word, return_inverse=True)
                number = mine if not first else np.unique(number * len(found) + mine, return_inverse=True)[1]
            number, self.bits = number.astype(np.uint64), max(1, int(number.max()).bit_length())
        self.owner, self.number = self._sorted(owner, number)
        new = np.append(True, (self.number[1:] != self.number[:-1]) | (self.owner[1:] != self.owner[:-1]))
        self.owner, self.number = self.owner[new], self.number[new]
        self.size = np.bincount(self.owner, minlength=len(lines))
        self.start = np.cumsum(self.size) - self.size
        spread = (self.number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        wide = max(SKETCH, 1 << (2 * len(self.number) // max(1, len(lines))).bit_length())  # two to four bits a shingle, so that few fall together
        spread = ((spread ^ (spread >> np.uint64(32))) * _MIX) >> np.uint64(64 - wide.bit_length() + 1)
        odd = np.zeros(len(lines) * wide, np.uint8)
        np.add.at(odd, self.owner * wide + spread.astype(np.int64), np.uint8(1))
        self.sketch = np.packbits((odd & 1).reshape(len(lines), wide), axis=1).view(np.uint64)

    def _sorted(self, owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers in order by owner; owners come ascending, from 0, and as many are sorted at once as fit beside the number's bits."""
        some = 1 << min(62 - self.bits, 20) if self.bits < 62 else 1
        out = np.empty_like(number)
        most = int(owner[-1]) + 1 if len(owner) else 0
        edge = np.searchsorted(owner, np.arange(0, most + some, some))
        low = np.uint64((1 << self.bits) - 1)
        for k, (a, b) in enumerate(zip(edge, edge[1:])):
            key = ((owner[a:b] - k * some).astype(np.uint64) << np.uint64(self.bits)) | number[a:b]
            key.sort()
            out[a:b] = key & low
        return owner, out  # as many numbers of each owner as before, so owners stay where they are

    def possible(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """False where sizes or sketches show that lines i and j cannot be alike: bits that differ are shingles of one line only."""
        a, b = self.size[i], self.size[j]
        apart = np.bitwise_count(self.sketch[i] ^ self.sketch[j]).sum(1, dtype=np.int64)
        total, most = ALIKE[0] + ALIKE[1], ALIKE[1] - ALIKE[0]
        return (np.minimum(a, b) * ALIKE[1] >= np.maximum(a, b) * ALIKE[0]) & (apart * total <= most * (a + b))

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The exact comparison, by counting common shingles: long pairs one by one, short ones some at a time."""
        sizes = self.size[i] + self.size[j]
        common = np.zeros(len(i), np.int64)
        long = sizes >= PAIR
        for k in np.flatnonzero(long).tolist():
            a, b = self.start[i[k]], self.start[j[k]]
            number = np.concatenate([self.number[a : a + self.size[i[k]]], self.number[b : b + self.size[j[k]]]])
            number.sort()
            common[k] = np.count_nonzero(number[1:] == number[:-1])
        short = np.flatnonzero(~long)
        for a, b in _stretches(sizes[short], 1 << 20):
            both = np.stack([i[short[a:b]], j[short[a:b]]], 1).ravel()  # the two lines of a pair after each other
            size = self.size[both]
            at = np.arange(size.sum()) + np.repeat(self.start[both] - (np.cumsum(size) - size), size)
            pair, number = self._sorted(np.repeat(np.arange(len(both)) // 2, size), self.number[at])
            twice = (number[1:] == number[:-1]) & (pair[1:] == pair[:-1])
            common[short[a:b]] = np.bincount(pair[1:][twice], minlength=b - a)
        return common * ALIKE[1] >= ALIKE[0] * (sizes - common)


def _stretches(sizes: np.ndarray, most: int):
    total = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def linked(lines: list[bytes], group: np.ndarray, side: np.ndarray, line: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (i, j) of alike lines of one group. Rows come by group, then side; with two sides only lines of different sides are compared.

    `line` has the line of each row where groups share lines; those linked in one group are not compared again in another.
    """
    sets = Shingles(lines)
    line = np.arange(len(lines)) if line is None else line
    crossed = np.bincount(group, side, minlength=int(group[-1]) + 1 if len(group) else 1)[group] > 0
    label = np.arange(len(lines))
    out_i, out_j = [], []
    i = np.arange(len(line))
    d = 0
    while True:  # each row with the d-th after it, d = 1, 2, ...
        d += 1
        i = i[i + d < len(line)]
        i = i[group[i] == group[i + d]]
        if not len(i):
            break
        j = i + d
        a, b = line[i], line[j]
        go = (label[a] != label[b]) & (~crossed[i] | (side[i] != side[j]))
        a, b = np.minimum(a, b)[go], np.maximum(a, b)[go]
        a, b = np.divmod(np.unique(a * len(lines) + b), len(lines))
        ok = sets.possible(a, b)
        a, b = a[ok], b[ok]
        if len(a):
            ok = sets.alike(a, b)
            a, b = a[ok], b[ok]
        if len(a):
            out_i.append(a)
            out_j.append(b)
            nodes, root = union(label[a], label[b])
            to = np.arange(len(lines))
            to[nodes] = root
            label = to[label]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def _verify(batches):
    """Sorted by m, g, g2, side: links of alike lines, many small groups at a time."""
    held: pa.Table | None = None
    src = dst = np.zeros(0, np.int64)
    for batch in _and_end(batches):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None:
            break
        g, g2 = (held.column(c).to_numpy() for c in ("g", "g2"))
        edge = np.append(np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (g2[1:] != g2[:-1]))), len(g))
        done = len(edge) - 1 if batch is None else len(edge) - 2  # the last group may go on
        if done <= 0:
            continue
        table = held.slice(0, edge[done]).combine_chunks()
        held = held.slice(edge[done]).combine_chunks() if edge[done] < len(g) else None
        lines = as_bytes(table.column("text").combine_chunks()).to_pylist()
        h = table.column("h").to_numpy()
        side = table.column("side").to_numpy()
        group = np.repeat(np.arange(done), np.diff(edge[: done + 1]))
        size = np.add.reduceat(np.fromiter(map(len, lines), np.int64, len(lines)), edge[:done])
        for a, b in _stretches(size, STRETCH):
            rows = slice(edge[a], edge[b])
            name, at, line = np.unique(h[rows], return_index=True, return_inverse=True)
            i, j = linked([lines[k] for k in (at + edge[a]).tolist()], group[rows] - a, side[rows], line)
            src, dst = np.concatenate([src, name[i]]), np.concatenate([dst, name[j]])
        if len(src) > 400_000:
            src, dst = spanning(src, dst)
    src, dst = spanning(src, dst)
    yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])
    tidy()


def _pick(batches):
    """Texts of the asked lines of each document, and where they stand."""
    for batch in batches:
        for part in slices(batch, "text"):
            asked = part.column("asked")
            count, rows = pc.list_value_length(asked).to_numpy(), asked.flatten()
            line = rows.field("line").to_pylist()
            texts, at = [], 0
            for t, n in zip(texts_of(part), count.tolist()):
                lines = t.split(b"\n")
                texts += [lines[k].strip(_BLANKS) for k in line[at : at + n]]
                at += n
            doc, th = (pa.array(np.repeat(part.column(c).to_numpy(), count)) for c in ("doc", "th"))
            yield pa.RecordBatch.from_arrays(
                [rows.field("h"), rows.field("h2"), doc, th, rows.field("line"), pa.array(texts, pa.binary())], names=["h", "h2", "doc", "th", "line", "text"]
            )
    tidy()


def _asked(groups: DataFrame) -> DataFrame:
    """(m, g, g2, side, h): the lines that each comparison needs; tiles of a large group alone and in pairs.

    Whole groups of one smallest member, of which there are no more than bands, have the same m: they share most of their lines.
    """
    member = F.explode("h").alias("h")
    whole = groups.where("tile < 0").dropDuplicates(["g", "g2"]).select(F.array_min("h").alias("m"), "g", "g2", F.lit(0).alias("side"), member)
    tiles = groups.where("tile >= 0")
    alone = tiles.select(F.xxhash64("g", "tile").alias("g"), F.xxhash64("tile", "g").alias("g2"), F.lit(0).alias("side"), member)
    other = tiles.select("g", F.col("tile").alias("tile2"), F.col("h").alias("hb"))
    pairs = tiles.join(other, "g").where("tile < tile2")
    name = (F.xxhash64("g", "tile", "tile2").alias("g"), F.xxhash64("tile2", "tile", "g").alias("g2"))
    left = pairs.select(*name, F.lit(0).alias("side"), member)
    right = pairs.select(*name, F.lit(1).alias("side"), F.explode("hb").alias("h"))
    return whole.unionByName(alone.unionByName(left).unionByName(right).withColumn("m", F.col("g")))


def kept_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, th, lines): numbers of the lines, not blank, that stay in each document that keeps any."""
    ship_code(docs.sparkSession)
    source = _source(docs, id_column, text)
    first = F.min(F.struct("doc", "th", "line")).alias("at")
    only = materialise(
        source.mapInArrow(_locate, "h bigint, h2 bigint, doc bigint, th bigint, line int")
        .repartition("h", "h2")  # slices have folded their copies; rows are sorted once, for one aggregate
        .groupBy("h", "h2").agg(first).select("h", "h2", "at.doc", "at.th", "at.line"),
        "lines",
    )
    parts = partitions(docs.sparkSession)
    groups = materialise(
        source.select("text").mapInArrow(_bands(BUCKETS * parts), _DEALT)
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_band_groups, _GROUP),
        "groups",
    )
    asked = _asked(groups)
    where = only.join(asked.select("h").distinct(), "h", "left_semi")
    wanted = where.groupBy("doc", "th").agg(F.collect_list(F.struct("h", "h2", "line")).alias("asked"))
    found = materialise(
        source.join(wanted, ["doc", "th"])
        .select("doc", "th", "text", "asked")
        .mapInArrow(_pick, "h bigint, h2 bigint, doc bigint, th bigint, line int, text binary")
        .repartition("h", "h2")  # before the aggregate, which then sorts the texts once
        .dropDuplicates(["h", "h2"]),
        "candidates",
    )
    links = (
        asked.join(found.select("h", "text"), "h")
        .repartition(parts, "m").sortWithinPartitions("m", "g", "g2", "side").select("g", "g2", "side", "h", "text")
        .mapInArrow(_verify, "src bigint, dst bigint")
    )
    joined = components(links)
    # 64 bits name a line among those compared, 128 among all
    member = joined.select(F.col("node").alias("h"), "component").join(found.drop("text"), "h")
    heads = member.groupBy("component").agg(F.min(F.struct("doc", "th", "line")).alias("at"))
    gone = member.join(heads, "component").where("struct(doc, th, line) <> at").select("doc", "th", "line", F.lit(True).alias("goes"))
    every = only.select("doc", "th", "line", F.lit(False).alias("goes")).unionByName(gone)
    lines, less = (F.collect_list(F.when(c, F.col("line"))) for c in (~F.col("goes"), F.col("goes")))
    return every.groupBy("doc", "th").agg(F.array_except(lines, less).alias("lines"))


def _rebuilt(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            texts, lines, removed = [], [], []
            for ident, raw, kept in zip(part.column("doc").to_pylist(), as_bytes(part.column("text")).to_pylist(), part.column("lines").to_pylist()):
                every = raw.split(b"\n") if raw is not None else []
                full = [i for i, x in enumerate(every) if x.strip(_BLANKS)]
                stay = set(kept or ()) if ident is not None else set(full)
                out = [x for i, x in enumerate(every) if i in stay or not x.strip(_BLANKS)]
                lines.append(len(full))
                removed.append(len(every) - len(out))
                texts.append(b"\n".join(out) if removed[-1] else raw)
            yield pa.RecordBatch.from_arrays(
                [part.column("kept"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())],
                names=["kept", "text", "n_lines", "n_removed"],
            )
    tidy()


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with `text` rebuilt of the lines that stay, and `n_lines`, `n_removed`, not counting blank lines."""
    kept = kept_lines(docs, id_column, text)
    rest = [c for c in docs.columns if c != text and c.lower() not in ("n_lines", "n_removed")]
    sent = packed(docs, rest, doc=column(id_column).cast("bigint"), th=F.xxhash64(column(text)), text=column(text).cast("string"))
    rows = sent.join(kept, ["doc", "th"], "left").select("kept", "doc", "text", "lines")
    schema = T.StructType([kept_field(sent), field("text", "string"), field("n_lines", "bigint"), field("n_removed", "bigint")])
    return unpacked(rows.mapInArrow(_rebuilt, schema), rest, F.col("text").alias(text), F.col("n_lines"), F.col("n_removed"))
