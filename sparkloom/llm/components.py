"""Distributed union-find: connected components of an edge table, and the local step that it repeats.

Each round contracts edges inside partitions (a union-find over what a task holds), deals
the remaining star edges out anew, and stops when nothing changes. Labels are the
smallest node reachable. No task holds more than its partition's edges; nothing is
collected but one count a round.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, remove, ship_code, tidy

#: Nodes of more edges are hubs. There are at most `MOST_HUBS` of them: with more edges the limit grows.
HUB_EDGES, MOST_HUBS = 500, 100_000


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) for edges a[i]-b[i]: hooking and pointer jumping."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[x], root[y]
        live = p != q
        if not live.any():
            return nodes, nodes[root]
        x, y, p, q = x[live], y[live], p[live], q[live]
        np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, root) with the connectivity of the edges given; at most one for each node."""
    if not len(a):
        return a, b
    nodes, label = union(a, b)
    keep = nodes != label
    return nodes[keep], label[keep]


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 500_000:
            a, b = spanning(a, b)
    a, b = spanning(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["src", "dst"])
    tidy()


def components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node with an edge. Null ends and loops are ignored; an empty table gives none.

    Rounds alternate between the large star (each node's larger neighbours move to its smallest
    neighbour) and the small star, which converge in a logarithmic number of rounds. A hub's
    neighbours are reduced to a minimum by a partial aggregate, never gathered in a list; its edges
    are labelled by a broadcast of at most `MOST_HUBS` hubs, never sent to one task.
    """
    spark = edges.sparkSession
    ship_code(spark)
    pairs = edges.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst")).where(
        "src <> dst"
    )
    now = materialise(pairs.mapInArrow(_contract, "src bigint, dst bigint"), "edges")
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("n")).select(
            F.col("src").alias("node"), F.least("src", "m").alias("m"), "n"
        )
        least = materialise(least, "least")
        # nodes of more edges than this are so few that they can be broadcast; their edges then stay where they are
        hub = max(HUB_EDGES, -(-2 * now.count() // MOST_HUBS))
        hubs, others = F.broadcast(least.where(F.col("n") > hub)), least.where(F.col("n") <= hub)
        hub_src = hubs.select(F.col("node").alias("src"), F.col("m").alias("hs"))
        hub_dst = hubs.select(F.col("node").alias("dst"), F.col("m").alias("hd"))
        marked = now.join(hub_src, "src", "left").join(hub_dst, "dst", "left")
        # every edge (u, v) with u > v: u goes to the least label around v, and v to the one around u
        of_src = marked.where("hs is null").join(others.select(F.col("node").alias("src"), F.col("m").alias("ms")), "src")
        half = of_src.select("src", "dst", "hd", "ms").unionByName(marked.where("hs is not null").select("src", "dst", "hd", F.col("hs").alias("ms")))
        of_dst = half.where("hd is null").join(others.select(F.col("node").alias("dst"), F.col("m").alias("md")), "dst")
        labelled = of_dst.select("src", "dst", "ms", "md").unionByName(half.where("hd is not null").select("src", "dst", "ms", F.col("hd").alias("md")))
        m = F.least("ms", "md")
        moved = labelled.select(
            F.explode(
                F.array(
                    F.struct(F.col("src").alias("a"), m.alias("b")),
                    F.struct(F.col("dst").alias("a"), m.alias("b")),
                    F.struct(F.col("ms").alias("a"), m.alias("b")),
                    F.struct(F.col("md").alias("a"), m.alias("b")),
                )
            ).alias("e")
        ).select(F.col("e.a").alias("src"), F.col("e.b").alias("dst"))
        after = materialise(
            moved.where("src <> dst").distinct().mapInArrow(_contract, "src bigint, dst bigint"), "edges"
        )
        remove(now)
        remove(least)
        # done when every node has one edge, to a node that has none of its own
        roots = after.select(F.col("dst").alias("src")).distinct().join(after, "src", "left_semi")
        more = after.groupBy("src").count().where("count > 1").select("src")
        now = after
        if roots.unionByName(more).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(
        now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    )
