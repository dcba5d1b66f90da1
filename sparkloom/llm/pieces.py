"""SentencePiece encoding and decoding by batched numpy Viterbi.

The vocabulary file gives pieces with scores; the segmentation with the largest sum of scores wins. No piece
goes on from another character into a blank mark, or over a line break, so a text falls into
chunks at those places without changing the result. Distinct chunks of equal length advance
together: hashes of all their substrings that end at one place probe the sorted piece keys of that length, and
vectorised maxima store backpointers. A chunk of over `LONG` characters advances alone, its maxima taken over the starts,
`BLOCK` places looked up at once, so that its cost and memory grow with its length. A character without a piece becomes byte
pieces. Ties go to the earliest start, the longest last piece. Pieces are found by 64-bit hashes; `identical` compares bytes.

Defined results: null and empty texts have no pieces and decode to the empty text; a text that holds the
blank mark U+2581 itself decodes to blanks there (the format cannot tell them apart), and
`identical` is false; bytes that are no UTF-8 cannot occur in a string column; texts and words may be of any length; repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field as default
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import column, field, kept_field, map_texts, packed, share, ship_code, tidy, unpacked

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: What a character without a piece costs below the least score, as in the published algorithm.
UNKNOWN_PENALTY = 10.0
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: First bits of a hash that a sieve tells apart.
SIEVE_BITS = 16
_SIEVE = np.uint64(64 - SIEVE_BITS)
_CHUNK = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: Distinct chunks remembered by a task.
MEMORY = 120_000
#: Text bytes encoded at once: many chunks of one length share the cost of each step.
SLICE = 2 << 20
#: Table cells of one Viterbi batch.
CELLS = 1 << 18
#: Characters of a chunk from which on it advances alone, and places looked up at once then.
LONG, BLOCK = 400, 1 << 14


def _prefixes(points: np.ndarray) -> np.ndarray:
    """Hashes of the first j characters of each column, j from 0: one row for each j."""
    out = np.zeros((points.shape[0] + 1, points.shape[1]), np.uint64)
    for j in range(points.shape[0]):
        out[j + 1] = out[j] * _BASE + points[j] * _SPREAD
    return out


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


@dataclass
class Keys:
    """The pieces of one length: sorted hashes, and whether any has the first bits of a hash."""

    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    sieve: np.ndarray = default(init=False)

    def __post_init__(self):
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self.keys >> _SIEVE] = True

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in `key`, piece numbers) of what is a piece."""
        row = np.flatnonzero(self.sieve[key >> _SIEVE])  # most substrings are no piece
        at = np.minimum(np.searchsorted(self.keys, key[row]), len(self.keys) - 1)
        hit = self.keys[at] == key[row]
        return row[hit], at[hit]


class Memory:
    """Chunks that a task has encoded: their ids, one after another. When it is full, only what the slice at hand needs stays."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, chunks: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.number.update(zip(chunks, range(len(self.size), len(self.size) + len(chunks))))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, ids])

    def keep(self, chunks: list[str]) -> None:
        at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        ids, size = self.ids[_ranges(self.start[at], self.size[at])], self.size[at]
        self.__init__()
        self.add(chunks, ids, size)


@dataclass
class Vocabulary:
    """Plain arrays of a piece file; the size is that of the file, and bounded by `most`."""

    pieces: list[bytes]  # what each id decodes to, with blanks for marks
    by_length: dict[int, Keys]
    byte_ids: np.ndarray
    least: float

    def __post_init__(self):
        self.longest = max(self.by_length)
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def viterbi(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, one after another, ids by chunk); chunks of equal length together."""
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        order = np.argsort(size, kind="stable")
        edge = np.flatnonzero(np.diff(size[order])) + 1
        found, count, rank = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], []
        for group in np.split(order, edge):
            n = int(size[group[0]]) if len(group) else 0
            step = max(1, CELLS // max(1, n)) if n <= LONG else 1
            for at in range(0, len(group), step):
                part = group[at : at + step].tolist()
                text = [chunks[k] for k in part]
                ids, per = self._equal(text, n) if n <= LONG else self._alone(text[0])
                found.append(ids)
                count.append(per)
                rank += part
        ids, count = np.concatenate(found), np.concatenate(count)
        where = np.empty(len(chunks), np.int64)
        where[rank] = np.arange(len(rank))
        start = np.cumsum(count) - count
        return ids[_ranges(start[where], count[where])], count[where]

    def _equal(self, chunks: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(-1, n).T
        hashes = _prefixes(points.astype(np.uint64))
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE)]))
        rows = len(chunks)
        best = np.full((n + 1, rows), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, rows), np.int32)  # start of the last piece
        what = np.full((n + 1, rows), -1, np.int32)  # its id; -1: bytes
        for j in range(1, n + 1):
            lone = np.zeros(rows, bool)
            for i in range(max(0, j - self.longest), j):
                keys = self.by_length.get(j - i)
                if keys is None:
                    continue
                row, at = keys.probe(hashes[j] - hashes[i] * power[j - i])
                if j - i == 1:
                    lone[row] = True
                total = best[i, row] + keys.scores[at]
                better = total > best[j, row]
                row, at = row[better], at[better]
                best[j, row] = total[better]
                back[j, row] = i
                what[j, row] = keys.ids[at]
            total = np.where(lone, -np.inf, best[j - 1] + self.least - UNKNOWN_PENALTY)
            row = np.flatnonzero(total > best[j])
            best[j, row] = total[row]
            back[j, row] = j - 1
            what[j, row] = -1
        # all rows walk back in step
        steps = []
        place = np.full(rows, n)
        every = np.arange(rows)
        while (place > 0).any():
            start = back[place, every]
            steps.append((start, np.where(place > 0, what[place, every], -2)))
            place = np.where(place > 0, start, 0)
        ids = np.stack([s[1] for s in reversed(steps)], 1)
        row, col = np.nonzero(ids != -2)
        flat = ids[row, col].astype(np.int32)
        if (flat >= 0).all():
            return flat, np.bincount(row, minlength=rows)
        starts = np.stack([s[0] for s in reversed(steps)], 1)[row, col]
        return self._with_bytes(flat, row, [chunks[r][s] for r, s in zip(row[flat < 0].tolist(), starts[flat < 0].tolist())], rows)

    def _with_bytes(self, ids: np.ndarray, row: np.ndarray, letters: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Each -1 becomes the byte pieces of its character."""
        coded = [x.encode() for x in letters]
        size = np.ones(len(ids), np.int64)
        size[ids < 0] = np.fromiter(map(len, coded), np.int64, len(coded))
        out = np.repeat(ids, size)
        out[np.repeat(ids < 0, size)] = self.byte_ids[np.frombuffer(b"".join(coded), np.uint8)]
        return out, np.bincount(row, size, rows).astype(np.int64)

    def _alone(self, chunk: str) -> tuple[np.ndarray, np.ndarray]:
        """One long chunk: the scores of all pieces that end at a place stand in a row, by length; maxima go over a row."""
        n, most = len(chunk), self.longest
        points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32).astype(np.uint64) * _SPREAD
        back, what = np.zeros(n + 1, np.int8), np.full(n + 1, -1, np.int32)
        best = deque([0.0], maxlen=most)  # of the latest places, the latest first
        for lo in range(0, n, BLOCK):
            hi = min(n, lo + BLOCK)
            score = np.full((hi - lo, most), -np.inf)
            ids = np.full((hi - lo, most), -1, np.int32)
            begin = max(0, lo - most + 1)
            h = np.zeros(hi - begin, np.uint64)
            for length in range(1, most + 1):
                # hashes of the substrings of this length, by their start from `begin`
                h = h[: max(0, hi - begin - length + 1)] * _BASE + points[begin + length - 1 : hi]
                keys = self.by_length.get(length)
                if keys is None or not len(h):
                    continue
                row, at = keys.probe(h)
                end = row + begin + length - 1 - lo
                ok = end >= 0
                score[end[ok], length - 1] = keys.scores[at[ok]]
                ids[end[ok], length - 1] = keys.ids[at[ok]]
            bytes_cost = self.least - UNKNOWN_PENALTY
            for j in range(lo, hi):
                total = score[j - lo, : len(best)] + best
                k = len(total) - 1 - int(total[::-1].argmax())  # of equal sums the earliest start
                top = total[k]
                if score[j - lo, 0] == -np.inf and best[0] + bytes_cost > top:
                    k, top = 0, best[0] + bytes_cost
                back[j + 1], what[j + 1] = k + 1, ids[j - lo, k]
                best.appendleft(float(top))
        out, starts, place = [], [], n
        while place > 0:
            out.append(int(what[place]))
            place -= int(back[place])
            starts.append(place)
        ids = np.array(out[::-1], np.int32)
        return self._with_bytes(ids, np.zeros(len(ids), np.int64), [chunk[s] for x, s in zip(out[::-1], starts[::-1]) if x < 0], 1)

    def encode(self, texts: list[str], memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after another, ids by text)."""
        memory = Memory() if memory is None else memory
        split = [_CHUNK.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        chunks = list(chain.from_iterable(split))
        wanted = set(chunks)
        fresh = list(wanted - memory.number.keys())
        if len(memory.number) + len(fresh) > MEMORY:
            memory.keep(list(wanted & memory.number.keys()))
        memory.add(fresh, *self.viterbi(fresh))
        at = np.fromiter(map(memory.number.__getitem__, chunks), np.int64, len(chunks))
        size = memory.size[at]
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split))))]
        return memory.ids[_ranges(memory.start[at], size)], np.diff(ends)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes that each text's ids stand for."""
        size = self.sizes[ids]
        flat = self.flat[_ranges(self.starts[ids], size)].tobytes()
        edge = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))].tolist()
        texts = [flat[a:b] for a, b in zip(edge, edge[1:])]
        return [t[1:] if t[:1] == b" " else t for t in texts]


def load(model: str = MODEL, most: int = 1_000_000) -> Vocabulary:
    """Read a piece file on the driver. Control and unknown pieces never stand for text."""
    from sentencepiece import SentencePieceProcessor

    file = SentencePieceProcessor(model_file=model)
    n = file.get_piece_size()
    if n > most:
        raise ValueError(f"{n} pieces; at most {most} are broadcast")
    pieces, names, ids, scores = [], [], [], []
    byte_ids = np.zeros(256, np.int32)
    for i in range(n):
        name = file.id_to_piece(i)
        if file.is_byte(i):
            value = int(name[3:5], 16)
            byte_ids[value] = i
            pieces.append(bytes([value]))
        elif file.is_control(i) or file.is_unknown(i) or file.is_unused(i):
            pieces.append(b"")
        else:
            if re.search(f"[^{MARK}]{MARK}|\n", name):
                raise ValueError(f"piece {i} crosses a chunk's end")
            pieces.append(name.replace(MARK, " ").encode())
            names.append(name)
            ids.append(i)
            scores.append(file.get_score(i))
    by_length = {}
    for length in sorted({len(x) for x in names}):
        at = np.array([k for k, x in enumerate(names) if len(x) == length])
        points = np.frombuffer("".join(names[k] for k in at).encode("utf-32-le"), np.uint32).reshape(-1, length).T
        keys = _prefixes(points.astype(np.uint64))[-1]
        order = np.argsort(keys)
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces share a hash; choose another base")
        at = at[order]
        by_length[length] = Keys(keys[order], np.array(ids, np.int32)[at], np.array(scores, np.float64)[at])
    return Vocabulary(pieces, by_length, byte_ids, float(min(scores)))


def encode(docs: DataFrame, keep: list[str], text: str = "text", model: str = MODEL) -> DataFrame:
    """`keep`, `pieces` (ids of the whole text), `identical`: whether decoding them gives the text back."""
    shared = share(docs.sparkSession, load(model))

    def make():
        v, memory = shared.value, Memory()

        def work(texts: list[bytes]) -> list[pa.Array]:
            ids, count = v.encode([t.decode("utf-8") for t in texts], memory)
            ends = np.append(0, np.cumsum(count)).astype(np.int32)
            return [
                pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32())),
                pa.array([a == b for a, b in zip(v.decode(ids, count), texts)], pa.bool_()),
            ]

        return work

    return map_texts(docs, keep, [field("pieces", "array<int>"), field("identical", "boolean")], make, text, SLICE)


def decode(rows: DataFrame, keep: list[str], pieces: str = "pieces", model: str = MODEL) -> DataFrame:
    """`keep` and `text`: what the ids stand for; a null list gives the empty text. Ids outside the file are an error."""
    from pyspark.sql import types as T

    ship_code(rows.sparkSession)
    shared = share(rows.sparkSession, load(model))
    keep = [k for k in keep if k.lower() != "text"]
    sent = packed(rows, keep, pieces=column(pieces))

    def run(batches):
        v = shared.value
        for batch in batches:
            lists = batch.column("pieces")
            count = np.fromiter((len(x) if x is not None else 0 for x in lists.to_pylist()), np.int64, len(lists))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t.decode("utf-8", "replace") for t in v.decode(ids, count)]
            yield pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string())], names=["kept", "text"])
        tidy()

    return unpacked(sent.mapInArrow(run, T.StructType([kept_field(sent), field("text", "string")])), keep, F.col("text"))
