"""SimHash near-duplicates: fingerprints, bit-sliced comparison, distributed union-find.

Only distinct fingerprints are compared. Two that differ in at most `radius` bits agree on
at least `blocks - radius` of `blocks` bit blocks, so each choice of that many blocks
is a table of buckets, and every link falls into one bucket at least; the number of blocks grows with the
table, so that buckets stay small. Bit planes stand vertically, 64 fingerprints a word; carry-save counters add up
the differing planes, and words of which all lanes exceed the radius are abandoned. Buckets up to `PACKED` stand side by
side in one row of lanes, compared with the row shifted by 1, 2, ... lanes, with lanes of two buckets masked; in larger
ones each fingerprint is compared with all lanes. A bucket larger than `tile` is dealt out as pairs of tiles. Buckets send on a
spanning forest of their links: connectivity whole, never a list of all pairs.

Defined results: null and empty texts have fingerprint zero and are linked like any other;
rows with a null doc_id get fingerprint but no part in components (component_id null); repeated
rows each give a row; rows of one id with different texts are linked by their texts alone; an empty table gives none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import column, field, map_texts, materialise, ship_code, split_words, tidy
from sparkloom.llm.components import components, spanning

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Least number of bit blocks beyond the radius: with radius 4 two of six agree, 15 tables of keys of 20 to 22 bits.
SPARE = 2
#: Fingerprints a bucket may hold on average before there are more blocks and longer keys.
CROWD = 64
#: Fingerprints of a bucket compared in one go.
TILE = 4096
#: Buckets up to this size stand side by side in words of lanes.
PACKED = 64
#: Rows whose buckets are compared together.
TOGETHER = 1 << 16
_FULL = ~np.uint64(0)


def fingerprint(text: bytes, shingle: int = SHINGLE, words=split_words) -> int:
    w = words(text)
    if not w:
        return 0
    line = b" ".join(w)
    if len(w) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        size = np.fromiter(map(len, w), np.int64, len(w)) + 1
        ends = np.cumsum(size) - 1
        starts = ends + 1 - size
        digest = xxhash.xxh64_intdigest
        cuts = zip(starts[: len(w) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        h = np.array([digest(line[a:b], SEED) for a, b in cuts], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, `keep` and `bits`, the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda texts: [
            pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), pa.int64())
        ]

    return map_texts(docs, [id_column, *keep], [field("bits", "bigint")], make, text)


def planes_of(prints: np.ndarray) -> np.ndarray:
    """Bit plane p, word w: bit p of fingerprints 64w to 64w+63."""
    n = -len(prints) % 64
    bits = np.unpackbits(
        np.concatenate([prints, np.zeros(n, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _sliced(difference, over: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, over): rows that have a lane at `radius` or less, and words whose bits say which lanes exceed it.

    `difference(p, rows)` gives the lanes that differ in plane p. Counters are bit-sliced too: a saturating carry-save
    count of width enough to tell `radius` from more. Every eight planes, rows whose lanes all exceed it leave.
    """
    width = max(1, radius.bit_length())
    live = np.arange(len(over))
    ones = [np.zeros_like(over) for _ in range(width)]
    for first in range(0, 64, 8):
        for p in range(first, first + 8):
            carry = difference(p, live)
            for c in range(width):
                ones[c], carry = ones[c] ^ carry, ones[c] & carry
            over = over | carry
        # more than radius: compare the sliced counters with the constant, from the top bit down
        more, same = np.zeros_like(over), np.full_like(over, _FULL)
        for c in reversed(range(width)):
            if radius >> c & 1:
                same = same & ones[c]
            else:
                more |= same & ones[c]
                same = same & ~ones[c]
        over = over | more
        keep = (over != _FULL).any(1)
        if not keep.all():
            live, over = live[keep], over[keep]
            ones = [x[keep] for x in ones]
        if not len(live):
            break
    return live, over


def within(query: np.ndarray, planes: np.ndarray, count: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, fingerprint number) of all pairs at `radius` or less."""
    over = np.zeros((len(query), planes.shape[1]), np.uint64)
    if count % 64:
        over[:, -1] = ~np.uint64((1 << (count % 64)) - 1)

    def difference(p: int, live: np.ndarray) -> np.ndarray:
        flip = np.where((query[live] >> np.uint64(p)) & np.uint64(1), _FULL, np.uint64(0))
        return planes[p][None] ^ flip[:, None]

    live, over = _sliced(difference, over, radius)
    hit = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")[:, :count]
    q, f = np.nonzero(hit)
    return live[q], f


def side_by_side(prints: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of one group at `radius` or less. Groups come sorted; all are compared at once."""
    planes = planes_of(prints)
    n, words = len(prints), planes.shape[1]
    out = []
    largest = int(np.bincount(group - group[0]).max()) if n else 0
    for d in range(1, largest):
        same = np.zeros(words * 64, bool)
        same[: n - d] = group[: n - d] == group[d:]
        lanes = np.packbits(same, bitorder="little").view(np.uint64)
        at = np.flatnonzero(lanes)
        word, bit = divmod(d, 64)
        after = np.concatenate([planes, np.zeros((64, word + 2), np.uint64)], 1)
        ahead = after[:, at + word]
        if bit:  # lane i of the shifted planes is lane i + d
            ahead = (ahead >> np.uint64(bit)) | (after[:, at + word + 1] << np.uint64(64 - bit))
        here = planes[:, at]
        live, over = _sliced(lambda p, rows, x=here, y=ahead: (x[p, rows] ^ y[p, rows])[:, None], ~lanes[at][:, None], radius)
        row, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
        i = at[live[row]] * 64 + lane
        out.append((i, i + d))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x[0] for x in out)]), np.concatenate([none, *(x[1] for x in out)])


def links(left: np.ndarray, right: np.ndarray, radius: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of left and right at `radius` or less, blocks of queries at a time."""
    planes = planes_of(right)
    out = []
    for i in range(0, len(left), step):
        a, b = within(left[i : i + step], planes, len(right), radius)
        out.append((a + i, b))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def blocks_for(count: int, radius: int) -> int:
    """Bit blocks for a table of `count` fingerprints: keys of about 64 * (blocks - radius) / blocks bits. The links found are the same."""
    blocks = radius + SPARE
    while blocks < 2 * radius + 2 and count >> (64 * (blocks - radius) // blocks) > CROWD:
        blocks += 1
    return blocks


def _masks(blocks: int, radius: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def near_pairs(prints: DataFrame, bits: str, node: str, radius: int = RADIUS, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """Spanning links (src, dst) between the nodes of distinct fingerprints at `radius` or less."""
    ship_code(prints.sparkSession)
    blocks = blocks or blocks_for(prints.count(), radius)
    keyed = prints.select(
        F.col(bits).alias("bits"),
        F.col(node).alias("node"),
        F.posexplode(F.array(*(F.col(bits).bitwiseAND(F.lit(_signed(m))) for m in _masks(blocks, radius)))).alias("t", "key"),
    )
    size = keyed.groupBy("t", "key").count().where("count > 1")
    # one row for each bucket tile: small buckets are tile (0, 0)
    kept = keyed.join(size, ["t", "key"])
    tiles = F.ceil(F.col("count") / tile).cast("int")
    own = F.pmod(F.xxhash64("bits"), tiles).cast("int")
    dealt = kept.withColumn("tiles", tiles).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    ).select(
        "t",
        "key",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).alias("right"),
        "bits",
        "node",
    )

    def compare(batches):
        yield from _compare_groups(batches, radius)

    parts = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return parts.mapInArrow(compare, "src bigint, dst bigint")


def _compare_groups(batches, radius: int):
    """Groups come sorted; the tail of a batch waits for the next, as its group may go on. A group is at most two tiles."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = ["src", "dst"]

    def flush(table: pa.Table, last: bool):
        nonlocal a, b
        cols = [table.column(c).to_numpy() for c in ("t", "key", "i", "j")]
        right = table.column("right").to_numpy()
        bits = table.column("bits").to_numpy().astype(np.int64).view(np.uint64)
        node = table.column("node").to_numpy()
        change = np.zeros(len(node), bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edge = np.append(np.flatnonzero(change), len(node))
        done = edge[-1] if last else edge[-2]
        size = np.diff(edge)
        group = np.repeat(np.arange(len(size)), size)
        small = (size <= PACKED) & (cols[2][edge[:-1]] == cols[3][edge[:-1]]) & (edge[1:] <= done)
        out_a, out_b = [a], [b]
        at = np.flatnonzero((small & (size > 1))[group])
        if len(at):
            x, y = side_by_side(bits[at], group[at], radius)
            out_a.append(node[at[x]])
            out_b.append(node[at[y]])
        for k in np.flatnonzero(~small & (size > 1) & (edge[1:] <= done)).tolist():
            s, e = edge[k], edge[k + 1]
            p, n, r = bits[s:e], node[s:e], right[s:e]
            if cols[2][s] == cols[3][s]:
                x, y = links(p, p, radius)
                out_a.append(n[x])
                out_b.append(n[y])
            elif r.any() and not r.all():
                x, y = links(p[~r], p[r], radius)
                out_a.append(n[~r][x])
                out_b.append(n[r][y])
            if sum(map(len, out_a)) > 400_000:
                u, v = spanning(np.concatenate(out_a), np.concatenate(out_b))
                out_a, out_b = [u], [v]
        a, b = spanning(np.concatenate(out_a), np.concatenate(out_b))
        return None if last else table.slice(done)

    waiting: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            rows += batch.num_rows
        if rows >= TOGETHER:
            held = flush(pa.Table.from_batches(waiting).combine_chunks(), False)
            waiting, rows = held.to_batches(), held.num_rows
    if rows:
        flush(pa.Table.from_batches(waiting).combine_chunks(), True)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)
    tidy()


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The id, `keep`, bits, component_id (the smallest id that links lead to) and component, the smallest fingerprint of the component.

    Nodes are fingerprints, not ids: rows that share an id with different texts are linked by their texts alone.
    """
    prints = materialise(fingerprints(docs, id_column, text, shingle, keep), "prints")
    known = prints.where(column(id_column).isNotNull())
    nodes = materialise(known.groupBy("bits").agg(F.min(column(id_column)).cast("bigint").alias("node")), "nodes")
    found = components(near_pairs(nodes, "bits", "bits", radius))
    label = nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select(
        "bits", "node", F.coalesce("component", "bits").alias("component")
    )
    least = label.groupBy("component").agg(F.min("node").alias("component_id"))
    label = label.join(least, "component").select("bits", "component", "component_id")
    out = prints.join(label, "bits", "left")
    told = column(id_column).isNotNull()
    return out.select(
        column(id_column), *(column(k) for k in keep), "bits", F.when(told, F.col("component_id")).alias("component_id"), F.when(told, F.col("component")).alias("component")
    )
