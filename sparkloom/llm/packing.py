"""Hierarchical packing of tokenised documents into training sequences of several context sizes.

Documents are tokenised once and packed where they are: a task gathers documents up to a bounded number of tokens, routes each to the
smallest context size that holds it (longer ones give whole windows of the largest size and a rest, which is routed like a document), packs one
size after another from the largest down, fills the gaps of a window with the largest shorter documents that fit, cuts a document only where
none fits, and deals the finished sequences over step groups of about equal tokens. Every sequence is exactly as long as its context size, a power of two, so
nothing is padded; what is left when a task ends becomes sequences of smaller powers of two. No shuffle and no global order is needed: numbers of
sequences carry the number of the task, and a lost task is redone from its own rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heapreplace
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkloom.llm.common import as_bytes, column, field, kept_field, packed, share, ship_code, slices, texts_of, tidy, unpacked
from sparkloom.llm.pieces import Memory, _ranges

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: The id that ends a document.
END = 1
#: Context sizes, powers of two, ascending.
TIERS = (128, 256, 512, 1024, 2048)
#: Tokens that are packed together, and tokens of a step group.
ROUND_TOKENS, STEP_TOKENS = 1 << 21, 1 << 16
#: Letters after which a long text is cut between two words, and words that a task remembers.
CUT, MEMORY = 1 << 20, 600_000
#: Bytes of texts that are encoded together.
SLICE = 4 << 20

# Texts of these letters, digits, signs and white space fall into the vocabulary's chunks by a pattern of the standard library.
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ʯ"
_PLAIN = re.compile(f"[{_LETTERS}\\x00-\\x08\\t\\n\\r\\x20-\\x7e«»¡¿£§°±×÷]*")
_CHUNK = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]++| ?[0-9]++| ?[^ \\t\\n\\r{_LETTERS}0-9]++|[ \\t\\n\\r]+(?![^ \\t\\n\\r])|[ \\t\\n\\r]+")
# White space around a blank: there a chunk can reach over the blank, elsewhere every blank begins one.
_REACHES = re.compile(r"\s (?:\s|$)")
_BETWEEN_WORDS = re.compile(r"[A-Za-z](?= [A-Za-z])")


class Encoder:
    """Ids of whole texts by a vocabulary file of byte pairs. A text is cut where the vocabulary's own splitting has a border, and what stands between two
    cuts is encoded once a task: chunks, or for texts of other letters words with their blanks. Texts with special strings or white space that reaches over a blank
    are left to the tokenizer whole.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added)) if added else None
        self.memory = Memory()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """All ids of each text."""
        out: list = [None] * len(texts)
        short, split = [], []
        for i, text in enumerate(texts):
            if self.special is not None and self.special.search(text):
                parts = None
            elif len(text) > CUT:
                out[i] = self._long(text)
                continue
            else:
                parts = _parts(text)
            if parts is None:
                out[i] = self._plain(text)
            else:
                short.append(i)
                split.append(parts)
        ids, size = self._look_up(list(chain.from_iterable(split)))
        ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(np.fromiter(map(len, split), np.int64, len(split))))]
        for i, a, b in zip(short, ends[:-1].tolist(), ends[1:].tolist()):
            out[i] = ids[a:b]
        return out

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _long(self, text: str) -> np.ndarray:
        """A long text in stretches that end between two words."""
        out, at = [], 0
        while at < len(text):
            cut = _BETWEEN_WORDS.search(text, at + CUT) if len(text) - at > CUT else None
            stop = cut.end() if cut else len(text)
            parts = _parts(text[at:stop])
            out.append(self._plain(text[at:stop]) if parts is None else self._look_up(parts)[0])
            at = stop
        return np.concatenate(out)

    def _look_up(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, ids by part), after encoding what is not remembered yet."""
        memory, wanted = self.memory, set(parts)
        fresh = list(wanted - memory.number.keys())
        if len(memory.number) + len(fresh) > MEMORY:
            memory.keep(list(wanted & memory.number.keys()))
        if fresh:
            done = self.tokenizer.encode(fresh, is_pretokenized=True, add_special_tokens=False)
            memory.add(fresh, np.array(done.ids, np.int32), np.bincount(np.array(done.word_ids, np.int64), minlength=len(fresh)))
        at = np.fromiter(map(memory.number.__getitem__, parts), np.int64, len(parts))
        size = memory.size[at]
        return memory.ids[_ranges(memory.start[at], size)], size


def _parts(text: str) -> list[str] | None:
    """A text cut at borders of the vocabulary's splitting; none: leave it to the tokenizer."""
    if _PLAIN.fullmatch(text):
        return _CHUNK.findall(text)
    if _REACHES.search(text):
        return None
    first, *words = text.split(" ")
    return [first, *(" " + w for w in words)]


class Pool:
    """Waiting pieces (document, start, length) by length; the longest of at most n is found in one step."""

    def __init__(self, longest: int):
        self.stacks: list[list] = [[] for _ in range(longest + 1)]
        self.there = 0

    def add(self, doc: int, start: int, length: int) -> None:
        if length:
            self.stacks[length].append((doc, start, length))
            self.there |= 1 << length

    def longest(self, most: int) -> int:
        """The longest length there of at most `most`; 0: none."""
        return max(0, (self.there & ((1 << most + 1) - 1)).bit_length() - 1)

    def take(self, length: int) -> tuple[int, int, int]:
        stack = self.stacks[length]
        piece = stack.pop()
        if not stack:
            self.there &= ~(1 << length)
        return piece


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS, last: bool = True) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Sequences, each a list of (document, start, length), and the pieces that wait for more documents (none if `last`).

    The lengths of a sequence's pieces add up to a tier; of the last ones to any power of two.
    """
    top, pool, done = tiers[-1], Pool(tiers[-1]), []
    for doc, n in enumerate(lengths):
        whole = n - n % top
        done.extend([(doc, at, top)] for at in range(0, whole, top))
        pool.add(doc, whole, n - whole)
    rest: list[tuple[int, int, int]] = []
    below = {t: (tiers[k - 1] if k else 0) for k, t in enumerate(tiers)}
    for tier in reversed(tiers):
        while (first := pool.longest(tier)) > below[tier]:
            held, gap = [pool.take(first)], tier - first
            while gap:
                fits = pool.longest(gap)
                if fits:
                    held.append(pool.take(fits))
                    gap -= fits
                    continue
                longer = pool.longest(top)
                if not longer:
                    break
                doc, start, n = pool.take(longer)
                held.append((doc, start, gap))
                pool.add(doc, start + gap, n - gap)
                gap = 0
            if gap:
                rest.extend(held)
            else:
                done.append(held)
    if not last:
        return done, rest
    # less than one window is left in all: cut it into powers of two, the largest first
    left = sum(n for _, _, n in rest)
    stream = iter(rest)
    doc = start = n = 0
    while left:
        gap = min(top, 1 << left.bit_length() - 1)
        left, held = left - gap, []
        while gap:
            if not n:
                doc, start, n = next(stream)
            part = min(n, gap)
            held.append((doc, start, part))
            start, n, gap = start + part, n - part, gap - part
        done.append(held)
    return done, []


def step_groups(sizes: np.ndarray, step_tokens: int = STEP_TOKENS) -> np.ndarray:
    """The group of each sequence: the longest first, each to the group of fewest tokens, so groups differ by one sequence at most."""
    total = int(sizes.sum())
    groups = max(1, round(total / step_tokens))
    heap = [(0, g) for g in range(groups)]
    heapify(heap)
    out = np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        tokens, g = heap[0]
        out[i] = g
        heapreplace(heap, (tokens + int(sizes[i]), g))
    return out


def pack_documents(
    docs: DataFrame,
    keep: list[str],
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end: int = END,
    tiers: tuple[int, ...] = TIERS,
    round_tokens: int = ROUND_TOKENS,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row a piece: `keep`, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset, context (the sequence's
    length), step_group.

    A document's ids are those of its whole text and the end id; a null or empty text has the end id alone. Every row is a document of its own, so repeated
    rows and null or repeated ids do no harm. Columns of `keep` that have the name of a result are replaced by it. An empty table gives no rows. The result depends
    on how Spark splits the table; each way is a whole and gapless packing.
    """
    spark = docs.sparkSession
    ship_code(spark)
    if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers have to be ascending powers of two")
    with open(tokenizer, encoding="utf-8") as file:
        shared = share(spark, file.read())
    fields = [field(n, "bigint") for n in ("start", "length")] + [field("ids", "binary")]
    fields += [field(n, "bigint") for n in ("doc_tokens", "sequence_id", "offset", "context", "step_group")]
    keep = [k for k in keep if k.lower() not in {f.name for f in fields}]
    sent = packed(docs, keep, text=column(text).cast("string"))
    schema = T.StructType([kept_field(sent), *fields])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(shared.value), TaskContext.get().partitionId() << 33
        number = group = 0
        kept: list[pa.Array] = []  # the rows that wait, as slices, with the ids of each
        ids: list[np.ndarray] = []
        waiting: list[tuple[int, int, int]] = []  # pieces of earlier rounds, by the numbers of `ids`
        tokens = 0

        def finish(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, group, kept, ids, waiting, tokens
            rows = pa.concat_arrays(kept)
            begun = {doc: start for doc, start, _ in waiting}
            if len(begun) < len(waiting):
                raise AssertionError("two waiting pieces of one document")
            ends = {doc: start + n for doc, start, n in waiting}
            first = [begun.get(i, 0) for i in range(len(ids))]
            sizes = [ends.get(i, len(x)) - f for i, (x, f) in enumerate(zip(ids, first))]
            done, rest = pack(sizes, tiers, last)
            lengths = np.array([sum(p[2] for p in s) for s in done], np.int64)
            groups = step_groups(lengths, step_tokens) if len(done) else lengths
            pieces = [(d, first[d] + s, n, k) for k, held in enumerate(done) for d, s, n in held]
            if pieces:
                doc, start, size, at = np.array(pieces, np.int64).T
                offset = np.cumsum(size) - size
                offset -= (np.cumsum(lengths) - lengths)[at]
                total = np.fromiter(map(len, ids), np.int64, len(ids))
                value = [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n in zip(doc.tolist(), start.tolist(), size.tolist())]
                most = max(1, int(len(value) * (4 << 20) / (int(size.sum()) * 4 + 1)))
                for a in range(0, len(value), most):
                    b = slice(a, a + most)
                    longs = (x[b] for x in (total[doc], task + number + at, offset, lengths[at], task + group + groups[at]))
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(pa.array(doc[b])), pa.array(start[b]), pa.array(size[b]), pa.array(value[b], pa.binary()), *map(pa.array, longs)], names=schema.names
                    )
            number, group = number + len(done), group + (int(groups.max()) + 1 if len(done) else 0)
            stay = sorted({d for d, _, _ in rest})
            new = {d: k for k, d in enumerate(stay)}
            waiting = [(new[d], first[d] + s, n) for d, s, n in rest]
            kept, ids, tokens = ([rows.take(pa.array(stay, pa.int64()))] if stay else []), [ids[d] for d in stay], 0

        for batch in batches:
            whole = pa.RecordBatch.from_arrays([batch.column("kept"), as_bytes(batch.column("text"))], names=["kept", "text"])
            for part in slices(whole, "text", SLICE):
                kept.append(part.column("kept"))
                for one in encoder([t.decode("utf-8") for t in texts_of(part)]):
                    ids.append(np.append(one, np.int32(end)).astype(np.int32))
                    tokens += len(ids[-1])
                if tokens >= round_tokens:
                    yield from finish(False)
        if kept:
            yield from finish(True)
        del encoder
        tidy()

    return unpacked(sent.mapInArrow(run, schema), keep, *(f.name for f in fields))
