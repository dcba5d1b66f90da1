"""Iterative graph operators over an edge table (src, dst): bounded rounds of joins, cut by checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.sources.stores import drop, new_path, written


def settle(df: DataFrame) -> DataFrame:
    """Write to the folder of spark.checkpoint.dir and read back, so that a lost executor costs a task, not the loop."""
    return written(df, "graph")


def arcs(edges: DataFrame) -> DataFrame:
    """Distinct arcs without loops and null ends."""
    return edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")).where("src <> dst").distinct()


def reachable(edges: DataFrame, seeds: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, depth): nodes reached from the seeds and in how many steps.

    Each round follows the frontier alone and writes it once, as the next depth of a partitioned table; nothing seen is written again.
    """
    spark, edges, path = edges.sparkSession, settle(arcs(edges)), new_path(edges.sparkSession, "reach")
    front = seeds.select(F.col("node").cast("bigint").alias("node")).where("node is not null").distinct()
    for depth in range(most_rounds + 1):
        front.write.parquet(f"{path}/depth={depth}")
        front = spark.read.schema("node bigint").parquet(f"{path}/depth={depth}")
        seen = spark.read.schema("node bigint, depth int").parquet(path)
        if front.isEmpty():
            return seen
        step = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = step.join(seen.select("node"), "node", "left_anti")
    raise RuntimeError("most_rounds is too small for this graph")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node connected to each, directions aside.

    Every node takes the least label around it, then the label of its label, which halves paths.
    """
    e = arcs(edges)
    both = settle(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = settle(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")))
    for _ in range(most_rounds):
        around = both.join(label, both["dst"] == label["node"]).groupBy("src").agg(F.min("component").alias("m"))
        took = label.join(around, label["node"] == around["src"], "left").select("node", F.least("component", "m").alias("c"))
        root = took.select(F.col("node").alias("c"), F.col("c").alias("up"))
        new = settle(took.join(root, "c", "left").select("node", F.least("c", "up").alias("component")))
        moved = new.join(label.withColumnRenamed("component", "was"), "node").where("component <> was")
        label = new
        if moved.isEmpty():
            return label
    raise RuntimeError("most_rounds is too small for this graph")


def _trimmed(left: DataFrame) -> DataFrame:
    """Arcs between nodes that have both predecessors and successors; the others are components of their own."""
    ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
    return settle(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))


def _contracted(left: DataFrame, most_rounds: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(arcs, chains, rings): every chain of nodes with one predecessor and one successor becomes one arc.

    `chains` has each such node with the nodes before and behind its chain; `rings` those of chains that close on themselves, with their component. Both ends are
    found by pointers that double, in as many rounds as the logarithm of the longest chain.
    """
    ins = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("i"), F.min("src").alias("entry")).where("i = 1")
    outs = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("o"), F.min("dst").alias("exit")).where("o = 1")
    links = settle(ins.join(outs, "node").select("node", "entry", "exit", F.col("node").alias("least")))
    total = links.count()
    if not total:
        return left, None, None
    now, live, spread = links, None, 1
    for _ in range(most_rounds):
        ahead = now.select(F.col("node").alias("exit"), F.col("exit").alias("further"), F.col("least").alias("least_ahead"))
        behind = now.select(F.col("node").alias("entry"), F.col("entry").alias("earlier"))
        step = now.join(ahead, "exit", "left").join(behind, "entry", "left").select(
            "node",
            F.coalesce("earlier", "entry").alias("entry"),
            F.coalesce("further", "exit").alias("exit"),
            F.least("least", "least_ahead").alias("least"),
            F.col("further").isNotNull().alias("live"),
        )
        after = settle(step)
        if now is not links:
            drop(now)
        now, before, live, spread = after, live, after.where("live").count(), spread * 2
        # an open chain gets shorter each round; what stays is rings, whose least node has come round once the pointers span them
        if not live or (live == before and spread > live):
            break
    else:
        raise RuntimeError("most_rounds is too small for this graph")
    rings = now.where("live").select("node", F.col("least").alias("component"))
    chains = now.where("not live").select("node", "entry", "exit")
    mine = links.select("node")
    rest = left.join(mine.withColumnRenamed("node", "src"), "src", "left_anti").join(mine.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    bridges = chains.select(F.col("entry").alias("src"), F.col("exit").alias("dst")).where("src <> dst")
    return settle(rest.unionByName(bridges).distinct()), chains, rings if live else None


def _coloured(left: DataFrame, most_rounds: int) -> DataFrame:
    """(node, component) of the components that hold the least node of their colour: it spreads forwards, and what leads back to it is found."""
    colour = settle(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("c", F.col("node")))
    for _ in range(most_rounds):
        come = left.join(colour, left["src"] == colour["node"]).groupBy("dst").agg(F.min("c").alias("m"))
        new = settle(colour.join(come, colour["node"] == come["dst"], "left").select("node", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("moved")))
        drop(colour)
        colour = new
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("most_rounds is too small for this graph")
    colour = colour.select("node", "c")
    same = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(
        colour.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst"
    ).where("cs = cd").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    back = reachable(same, colour.where("node = c").select("node"), most_rounds)
    return settle(back.join(colour, "node").select("node", F.col("c").alias("component")))


def strong_components(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, component): strongly connected components, labelled by their smallest node; single nodes are their own.

    Nodes without predecessors or successors go, chains become arcs, and this is repeated while it helps: a path or a ring of n nodes takes some log n rounds. What is
    left is coloured: rounds then follow the longest shortest way in it. Chains are put back in the end: their nodes belong to the component of both their ends, if that
    is one, and to none otherwise.
    """
    e = settle(arcs(edges))
    nodes = settle(e.select(F.col("src").alias("node")).union(e.select("dst")).distinct())
    found, chains, left, size = [], [], e, e.count()
    for _ in range(most_rounds):
        while size:
            trimmed = _trimmed(left)
            left, links, rings = _contracted(trimmed, most_rounds)
            chains += [links] if links is not None else []
            found += [rings] if rings is not None else []
            before, size = size, left.count()
            if size == before:
                break
        if not size:
            break
        some = _coloured(left, most_rounds)
        found.append(some)
        mine = some.select("node")
        left = settle(left.join(mine.withColumnRenamed("node", "src"), "src", "left_anti").join(mine.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        size = left.count()
    else:
        raise RuntimeError("most_rounds is too small for this graph")
    label = nodes.select("node", F.col("node").alias("component"))
    if found:
        every = found[0]
        for some in found[1:]:
            every = every.unionByName(some)
        label = settle(nodes.join(every, "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    for links in reversed(chains):
        x, y = label.select(F.col("node").alias("entry"), F.col("component").alias("cx")), label.select(F.col("node").alias("exit"), F.col("component").alias("cy"))
        put = links.join(x, "entry").join(y, "exit").where("cx = cy").select("node", F.col("cx").alias("to"))
        label = settle(label.join(put, "node", "left").select("node", F.coalesce("to", "component").alias("component")))
    if not chains:
        return label
    # the smallest node may be one of a chain
    least = label.groupBy("component").agg(F.min("node").alias("least"))
    return label.join(least, "component").select("node", F.col("least").alias("component"))


def positions(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(node, indeg, outdeg, component, size, reached): degrees over distinct arcs, the strong component, and 1 for nodes that the seeds reach (without seeds: none)."""
    e = settle(arcs(edges))
    ins = e.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("indeg"))
    outs = e.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outdeg"))
    strong = strong_components(e)
    size = strong.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    whole = strong.join(size, "component").join(ins, "node", "left").join(outs, "node", "left")
    if seeds is None:
        whole = whole.withColumn("reached", F.lit(0))
    else:
        whole = whole.join(reachable(e, seeds).select("node", F.lit(1).alias("reached")), "node", "left")
    return whole.select(
        "node", F.coalesce("indeg", F.lit(0)).alias("indeg"), F.coalesce("outdeg", F.lit(0)).alias("outdeg"), "component", "size", F.coalesce("reached", F.lit(0)).alias("reached")
    )


def dead_gate(verdicts: DataFrame) -> DataFrame:
    """(dead, reported, failed), one row: unreached single files fail the gate, unreached aggregates are reported only. `verdicts` has verdict and grain ('file' or another)."""
    file = F.col("grain") == "file"
    return verdicts.agg(F.count_if(file).alias("dead"), F.count_if(~file).alias("reported"), F.coalesce(F.bool_or(file), F.lit(False)).alias("failed"))


def dead_verdicts(nodes: DataFrame, edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(node, verdict): 1 + public + 2 * referenced for nodes that no entry reaches; `nodes` has node and public."""
    reach = reachable(edges, entries).select("node")
    used = arcs(edges).select(F.col("dst").alias("node")).distinct().withColumn("used", F.lit(1))
    lost = nodes.join(reach, "node", "left_anti").join(used, "node", "left")
    return lost.select("node", (1 + F.col("public").cast("int") + 2 * F.coalesce("used", F.lit(0))).cast("int").alias("verdict"))
