"""Exact top-k inner-product search with a dual-tree walk over cover trees.

Vectors are dealt into blocks. A task builds a cover tree of its block and one of each block of queries, and
walks pairs of nodes: a pair is pruned when the best score that its centres and covering
radii allow is below the worst kth score in the query node. Before that, every query is searched
in one seed block, of bounded size, whose kth score then goes with the query as a floor to all
blocks, so that blocks send on only what can still count. Scores are integers and exact: where norms leave room for rounding in
double precision, survivors are scored again in whole numbers. Bounds are rounded up, and ties are never pruned.

A block of candidates is dealt out to several tasks, each with a share of the queries, where there are fewer blocks than partitions.

Defined results: vectors null or holding null or non-finite components take no part; a shorter vector counts as filled up with zeros;
a null id takes no part; repeated rows are candidates of their own; a query is never its own candidate, by id; the rows of one query
id are searched together, each with all candidates; a score beyond a long is an error.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import column, materialise, partitions, ship_code, tidy

K, SCALE = 20, 64
#: Rows of a block of candidates and of a block of queries.
BLOCK_ROWS, QUERY_ROWS = 16_384, 512
LEAF = 64
NONE = -(1 << 63)
#: Sums of whole numbers below this are exact in double precision.
EXACT = float(1 << 53)


@dataclass
class Tree:
    """Cover tree nodes in arrays: centre, covering radius, children or a slice of `order` (leaves)."""

    centre: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: list[np.ndarray]
    order: np.ndarray


def cover_tree(x: np.ndarray, leaf: int = LEAF, ratio: float = 0.7) -> Tree:
    """Each node covers its points within `radius` of its centre, one of them. A child's centre is farther than
    `ratio` times the parent's radius from those before it, and its points lie closer than that to it."""
    order = np.arange(len(x))
    centres, radii, first, last, children = [], [], [], [], []

    def add(lo: int, hi: int, centre: int, d: np.ndarray) -> int:
        centres.append(centre)
        radii.append(float(d.max()) if len(d) else 0.0)
        first.append(lo)
        last.append(hi)
        children.append(np.zeros(0, np.int64))
        return len(centres) - 1

    def distance(rows: np.ndarray, centre: int) -> np.ndarray:
        return np.sqrt(((x[rows] - x[centre]) ** 2).sum(1))

    work = [add(0, len(x), 0, distance(order, 0))] if len(x) else []
    while work:
        node = work.pop()
        lo, hi = first[node], last[node]
        if hi - lo <= leaf or radii[node] == 0:
            continue
        rows = order[lo:hi]
        near = distance(rows, centres[node])
        owner = np.zeros(len(rows), np.int64)
        picked = [centres[node]]
        reach = ratio * radii[node]
        while near.max() > reach and len(picked) < 32:
            far = int(near.argmax())
            d = distance(rows, int(rows[far]))
            closer = d < near
            near = np.where(closer, d, near)
            owner[closer] = len(picked)
            picked.append(int(rows[far]))
        sort = np.argsort(owner, kind="stable")
        order[lo:hi] = rows[sort]
        near, size = near[sort], np.bincount(owner, minlength=len(picked))
        kids, at = [], 0
        for c, n in zip(picked, size.tolist()):
            if n:
                kids.append(add(lo + at, lo + at + n, c, near[at : at + n]))
                at += n
        children[node] = np.array(kids)
        work += kids
    c = x[np.array(centres, np.int64)] if centres else np.zeros((0, x.shape[1]))
    return Tree(c, np.array(radii), np.sqrt((c**2).sum(1)), np.array(first), np.array(last), children, order)


def dual_search(q: np.ndarray, q_id: np.ndarray, floor: np.ndarray, x: np.ndarray, x_id: np.ndarray, tree: Tree, k: int = K):
    """(query number, candidate number, score) of every query's k best candidates at `floor` or more."""
    mine = cover_tree(q)
    top = np.full((len(q), k), NONE, np.int64)
    top_row = np.full((len(q), k), -1, np.int64)
    worst = np.maximum(floor, NONE)
    far_q, far_x = np.sqrt((q**2).sum(1)), np.sqrt((x**2).sum(1)) if len(x) else np.zeros(0)
    loose = len(q) > 0 and len(x) > 0 and far_q.max() * far_x.max() >= EXACT  # rounding is possible somewhere
    if not len(q) or not len(x):
        return top, top_row

    def bound(a: int, b: np.ndarray) -> np.ndarray:
        c = tree.centre[b] @ mine.centre[a]
        slack = 1e-12 * mine.norm[a] * tree.norm[b]  # for rounding where the product cancels out
        return c + mine.norm[a] * tree.radius[b] + mine.radius[a] * tree.norm[b] + mine.radius[a] * tree.radius[b] + slack

    def limit(a: int) -> float:
        return worst[mine.order[mine.first[a] : mine.last[a]]].min()

    def base(a: int, b: int) -> None:
        rows, cand = mine.order[mine.first[a] : mine.last[a]], tree.order[tree.first[b] : tree.last[b]]
        for at in range(0, len(cand), 4096):  # a leaf of equal vectors can be of any size
            c = cand[at : at + 4096]
            s = _scores(q[rows], x[c], worst[rows]) if loose else (q[rows] @ x[c].T).astype(np.int64)
            s[q_id[rows][:, None] == x_id[c][None]] = NONE
            live = np.flatnonzero((s >= worst[rows][:, None]).any(1))
            for i in live.tolist():
                r = rows[i]
                score = np.concatenate([top[r], s[i]])
                row = np.concatenate([top_row[r], c])
                score = np.where(score < worst[r], NONE, score)
                ids = np.where(row < 0, np.iinfo(np.int64).max, x_id[row])
                best = np.lexsort((ids, ~score))[:k]
                top[r], top_row[r] = score[best], np.where(score[best] == NONE, -1, row[best])
                worst[r] = max(worst[r], top[r][-1])

    # pairs on a stack, the most promising reference child last, so that floors rise early
    stack = [(0, 0, np.inf)]
    while stack:
        a, b, best = stack.pop()
        if best + 1e-6 * (1 + abs(best) if np.isfinite(best) else 1) < limit(a):
            continue
        down_q, down_x = mine.children[a], tree.children[b]
        if not len(down_q) and not len(down_x):
            base(a, b)
            continue
        if not len(down_x) or (len(down_q) and mine.radius[a] > tree.radius[b]):
            stack += [(int(c), b, float(bound(int(c), np.array([b]))[0])) for c in down_q]
        else:
            bounds = bound(a, down_x)
            for i in np.argsort(bounds).tolist():
                stack.append((a, int(down_x[i]), float(bounds[i])))
    return top, top_row


def _scores(q: np.ndarray, x: np.ndarray, worst: np.ndarray) -> np.ndarray:
    """Exact scores of all pairs that can reach `worst`; of others something below it."""
    near = q @ x.T
    reach = np.sqrt((q**2).sum(1))[:, None] * np.sqrt((x**2).sum(1))[None]
    error = np.where(reach < EXACT, 0.0, reach * (q.shape[1] + 2) * 2.0**-52)
    out = np.full(near.shape, NONE, np.int64)
    sure = error == 0
    out[sure] = near[sure].astype(np.int64)
    for i, j in np.argwhere(~sure & (near + error >= worst[:, None].astype(np.float64) * (1 - np.sign(worst)[:, None] * 1e-15))).tolist():
        score = sum(int(u) * int(v) for u, v in zip(q[i], x[j]))
        if not -(1 << 63) < score < 1 << 63:
            raise OverflowError(f"a score of {score} is beyond a long")
        out[i, j] = score
    return out


def _floor(x):
    """The floor of a double as a double; from 2**53 on doubles are whole, and a long may not hold them."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def quantise(vectors: DataFrame, id_column: str, vector: str, scale: int = SCALE) -> DataFrame:
    """id and floor(scale * x) of every usable vector, whole numbers in doubles; unusable ones are left out."""
    finite = lambda c: ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    # an unusable component makes its place null, whichever condition Spark evaluates first
    v = F.transform(column(vector), lambda c: _floor(F.lit(float(scale)) * F.when(finite(c), c.cast("double"))))
    usable = vectors.where(column(id_column).isNotNull() & column(vector).isNotNull())
    return usable.select(column(id_column).cast("bigint").alias("id"), v.alias("v")).where(
        (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull())
    )


def exact_top_k(
    vectors: DataFrame,
    is_query,
    id_column: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank from 1, vec_id, score. `is_query` is a condition on the column `id`."""
    spark = vectors.sparkSession
    ship_code(spark)
    every = quantise(vectors, id_column, vector, scale)
    shape = every.agg(F.max(F.size("v")).alias("n"), F.count(F.lit(1)).alias("count")).first()
    if not shape["count"]:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width, rows = shape["n"], shape["count"]
    every = every.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    blocks = max(1, -(-rows // block_rows))
    # whole numbers of the id's hash deal rows out evenly, however ids or copies lie
    data = every.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    queries = every.where(is_query)
    seed = data.where("block = 0").limit(block_rows)
    groups = max(1, -(-queries.count() // query_rows))
    dealt = queries.withColumn("g", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(groups)).cast("int"))

    # a block goes to so many tasks, each with some groups of queries
    parts = max(1, min(groups, partitions(spark) // blocks))

    def search(batches, floors: bool):
        """Rows: block, part, g (null: a candidate), id, v, floor; sorted by block and part, candidates first, then by g."""
        held_block, tree, x, x_id = None, None, None, None
        pending: list = []
        group: list = []
        group_key = None

        def run():
            nonlocal tree, x, x_id, pending
            if pending:
                x = np.array([r[1] for r in pending], np.float64)
                x_id = np.array([r[0] for r in pending], np.int64)
                tree, pending = cover_tree(x), []
            if not group or tree is None:
                return None
            q_id = np.array([r[0] for r in group], np.int64)
            q = np.array([r[1] for r in group], np.float64)
            floor = np.array([r[2] for r in group], np.int64)
            top, row = dual_search(q, q_id, floor, x, x_id, tree, k)
            if floors:
                return pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(top[:, -1])], names=["id", "floor"])
            at, col = np.nonzero(row >= 0)
            return pa.RecordBatch.from_arrays(
                [pa.array(q_id[at]), pa.array(x_id[row[at, col]]), pa.array(top[at, col])], names=["query_id", "vec_id", "score"]
            )

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("block", "part", "g", "id", "floor")]
            v = batch.column("v").flatten().to_numpy().reshape(-1, width) if batch.num_rows else []
            for i, (block, part, g, ident, f) in enumerate(zip(*cols)):
                b = (block, part)
                if (b, g) != group_key:
                    out = run()
                    if out is not None:
                        yield out
                    group, group_key = [], (b, g)
                    if b != held_block:
                        held_block, tree, pending = b, None, []
                if g is None:
                    pending.append((ident, v[i]))
                else:
                    group.append((ident, v[i], f))
        out = run()
        if out is not None:
            yield out
        tidy()

    def deal(candidates: DataFrame, asked: DataFrame, floors: bool, kind: str) -> DataFrame:
        both = candidates.select("block", "part", F.lit(None).cast("int").alias("g"), "id", F.lit(None).cast("bigint").alias("floor"), "v").unionByName(
            asked.select("block", "part", "g", "id", "floor", "v")
        )
        return both.repartition(partitions(spark), "block", "part").sortWithinPartitions("block", "part", F.col("g").asc_nulls_first(), "id").mapInArrow(
            lambda b: search(b, floors), kind
        )

    # the seed block is copied to every task of queries: it is at most block_rows rows
    seeds = seed.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("block"), F.lit(0).alias("part"), "id", "v")
    floors = deal(
        seeds, dealt.select(F.col("g").alias("block"), F.lit(0).alias("part"), F.lit(0).alias("g"), "id", F.lit(NONE).alias("floor"), "v"), True, "id bigint, floor bigint"
    )
    floors = materialise(floors.groupBy("id").agg(F.max("floor").alias("floor")), "floors")
    asked = dealt.join(floors, "id").select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod("g", F.lit(parts)).alias("part"), "g", "id", "floor", "v"
    )
    data = data.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    found = deal(data, asked, False, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
