"""Queries over graphs that the tables hold: parts that follow each other in an order, and the region tree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import graph
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_FULL = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
_ORDER = ", ".join(_FULL)


def part_arcs(spark, d):
    """Arcs between parts on consecutive lines of an order."""
    items = table(spark, d, "lineitem")
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*_FULL))
    return graph.arcs(items.select(F.col("l_partkey").alias("src"), after.alias("dst")).where("dst is not null"))


def dated_arcs(spark, d):
    """The same arcs, each led from the part that was shipped first (ties: the smaller key) to the other: no cycle by nature."""
    first = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_shipdate").alias("t"))
    both = part_arcs(spark, d).join(first.toDF("src", "ts"), "src").join(first.toDF("dst", "td"), "dst")
    a, b = F.struct(F.col("ts").alias("t"), F.col("src").alias("p")), F.struct(F.col("td").alias("t"), F.col("dst").alias("p"))
    return graph.arcs(both.select(F.least(a, b)["p"].alias("src"), F.greatest(a, b)["p"].alias("dst")))


_FOLLOW = f"""(select distinct l_partkey as src, dst from (
    select *, lead(l_partkey) over (partition by l_orderkey order by {_ORDER}) as dst from lineitem)
    where dst is not null and dst <> l_partkey)"""
_ARCS = f"arcs as {_FOLLOW}"
_DATED = f"""first as (select l_partkey as p, min(l_shipdate) as t from lineitem group by 1),
arcs as (select distinct case when (x.t, src) < (y.t, dst) then src else dst end as src, case when (x.t, src) < (y.t, dst) then dst else src end as dst
    from {_FOLLOW} join first x on x.p = src join first y on y.p = dst)"""
_TREE = """arcs as (select distinct c_custkey as src, -1000 - c_nationkey as dst from customer union select -1000 - n_nationkey, -1 - n_regionkey from nation)"""
_SEEDED = """seeds as (select min(src) as node from arcs union select max(src) from arcs),
reach(node) as (select node from seeds union select dst from reach join arcs on src = node)"""
_TRANSIT = "reach(a, b) as (select src, dst from arcs union select a, dst from reach join arcs on src = b)"


def _ends(e):
    return e.agg(F.min("src").alias("x"), F.max("src").alias("y")).select(F.explode(F.array("x", "y")).alias("node"))


@query(f"with {_ARCS} select src, dst from arcs")
def graph_edge_projection(spark, d):
    """Distinct arcs without loops."""
    return part_arcs(spark, d)


@query(f"with recursive {_ARCS}, {_SEEDED} select node from reach")
def graph_reachable(spark, d):
    """Parts that the first and the last source reach."""
    e = part_arcs(spark, d)
    return graph.reachable(e, _ends(e)).select("node")


# the least node of a component spreads over all of it, though labels pass to larger nodes only
@query(
    f"""with recursive {_ARCS}, both_ways as (select src, dst from arcs union select dst, src from arcs),
reach(a, b) as (select src, src from both_ways union select a, dst from reach join both_ways on src = b and dst > a)
select b as node, min(a) as component from reach group by b"""
)
def graph_components(spark, d):
    """Connected components, directions aside, by iterated least labels."""
    return graph.components(part_arcs(spark, d))


_STRONG = f"""with recursive {_ARCS}, {_TRANSIT},
nodes as (select src as node from arcs union select dst from arcs),
mutual as (select x.a as node, x.b as mate from reach x join reach y on x.a = y.b and x.b = y.a),
strong as (select node, least(node, coalesce(min(mate), node)) as component from nodes left join mutual using (node) group by node)"""


@query(f"{_STRONG} select node, component from strong")
def graph_strong_components(spark, d):
    """Strongly connected components by colouring."""
    return graph.strong_components(part_arcs(spark, d))


@query(f"{_STRONG} select component, cast(count(*) as bigint) as size from strong group by component having count(*) >= 2")
def graph_cycles(spark, d):
    """Components of two nodes or more: cycles."""
    s = graph.strong_components(part_arcs(spark, d))
    return s.groupBy("component").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")


@query(
    f"""with recursive {_TREE}, {_TRANSIT}
select cast((select count(*) from (select src from arcs union select dst from arcs)) as bigint) as nodes, cast(count(*) as bigint) as arcs,
    cast(count(*) filter (exists (select 1 from reach where a = dst and b = src)) as bigint) as on_cycles from arcs"""
)
def graph_cycles_absent(spark, d):
    """The acyclic twin, customer to nation to region (negative ids): its nodes, its arcs, and the arcs inside a strong component, of which there are none."""
    nation = lambda c: -1000 - F.col(c)
    low = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), nation("c_nationkey").alias("dst"))
    mid = table(spark, d, "nation").select(nation("n_nationkey").alias("src"), (-1 - F.col("n_regionkey")).alias("dst"))
    e = graph.arcs(low.unionByName(mid))
    s = graph.settle(graph.strong_components(e))
    inside = e.join(s.toDF("src", "cs"), "src").join(s.toDF("dst", "cd"), "dst").agg(F.count(F.lit(1)).alias("arcs"), F.count_if(F.col("cs") == F.col("cd")).alias("on_cycles"))
    return s.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(inside)  # one row by one row


@query(
    f"""{_STRONG}, {_SEEDED.replace("reach", "come")},
size as (select component, count(*) as size from strong group by component),
i as (select dst as node, count(*) as indeg from arcs group by dst), o as (select src as node, count(*) as outdeg from arcs group by src)
select node, cast(coalesce(indeg, 0) as bigint) as indeg, cast(coalesce(outdeg, 0) as bigint) as outdeg, component, cast(size as bigint) as size,
    cast(node in (select node from come) as int) as reached
from strong join size using (component) left join i using (node) left join o using (node)"""
)
def graph_positions(spark, d):
    """Degrees, strong component and the reach bit of every part that has an arc."""
    e = part_arcs(spark, d)
    return graph.positions(e, _ends(e))


@query(
    f"""with recursive {_DATED}, {_SEEDED}
select p_partkey as node, cast(1 + cast(p_size >= 25 as int) + 2 * cast(p_partkey in (select dst from arcs) as int) as int) as verdict
from part where p_partkey not in (select node from reach)"""
)
def graph_dead_verdicts(spark, d):
    """Parts that no entry reaches along arcs from earlier to later parts: 1 + public + 2 * referenced."""
    e = dated_arcs(spark, d)
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") >= 25).alias("public"))
    return graph.dead_verdicts(nodes, e, _ends(e))


_GRAIN = "case when p_type like 'PROMO%' then 'section' when p_size > 45 then 'package' else 'file' end"


@query(
    f"""with recursive {_DATED}, {_SEEDED}, v as (select p_partkey, {_GRAIN} as grain from part where p_partkey not in (select node from reach))
select cast(count(*) filter (grain = 'file') as bigint) as dead, cast(count(*) filter (grain <> 'file') as bigint) as reported,
    coalesce(bool_or(grain = 'file'), false) as failed from v"""
)
def graph_dead_gate(spark, d):
    """The gate over the verdicts: parts of the finest grain fail it, larger ones (here some types and sizes) are reported only."""
    verdicts = graph_dead_verdicts(spark, d)
    grain = table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.expr(_GRAIN).alias("grain"))
    return graph.dead_gate(verdicts.join(grain, "node"))


@query(
    """with n as (select 'c' || c_custkey as child, 'n' || c_nationkey as parent from customer
    union all select 'n' || n_nationkey, 'r' || n_regionkey from nation)
select parent, cast(count(*) as bigint) as subtree from (
    select parent from n union all select b.parent from n a join n b on a.parent = b.child) group by parent"""
)
def tree_subtree_rollup(spark, d):
    """Members under each node of the customer, nation, region tree: levels joined from below."""
    low = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"))
    mid = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    per = low.groupBy("parent").agg(F.count(F.lit(1)).alias("subtree"))
    up = mid.join(per, mid["child"] == per["parent"], "left").groupBy(mid["parent"]).agg(
        (F.count(F.lit(1)) + F.coalesce(F.sum("subtree"), F.lit(0))).alias("subtree")
    )
    return per.unionByName(up)
