"""Queries for joins beyond equality: bands, intervals, as-of, semi, anti, outer legs, ladders, mentions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.operators import intervals
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table


@query(
    f"""select a.p_brand as brand, a.p_partkey as a, b.p_partkey as b from part a join part b
    on a.p_brand = b.p_brand and (a.p_size < b.p_size or (a.p_size = b.p_size and a.p_partkey < b.p_partkey)) and a.p_size * 100 >= 85 * b.p_size
    where a.p_size > 0"""
)
def band_join(spark, d):
    """Pairs of parts of one brand whose sizes are within 85 in 100."""
    part = table(spark, d, "part").withColumnRenamed("p_brand", "brand")
    return intervals.band_pairs(part, "brand", "p_partkey", "p_size", *knobs.SIZE_RATIO)


@query(
    """with s as (select o_custkey as c, epoch(o_orderdate) // 86400 as pt, max(o_totalprice) as price from orders group by all),
p as (select distinct o_custkey as c, epoch(l_shipdate) // 86400 as pt, l_orderkey as k from lineitem join orders on l_orderkey = o_orderkey)
select p.c, cast(p.pt as bigint) as pt, p.k, s.price from p asof left join s on p.c = s.c and p.pt >= s.pt"""
)
def as_of_join(spark, d):
    """The customer's last order at or before each shipment day: one sorted union, no inequality join."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("bigint")
    orders = table(spark, d, "orders")
    s = orders.select(F.col("o_custkey").alias("c"), day("o_orderdate").alias("pt"), F.col("o_totalprice").alias("price"))
    li = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    p = li.select(F.col("o_custkey").alias("c"), day("l_shipdate").alias("pt"), F.col("l_orderkey").alias("k")).distinct()
    return intervals.as_of(p, s, ["c"], "pt", "price", ["k"])


_SPANS = """s as (select o_custkey as c, o_orderkey as span, epoch(o_orderdate) // 86400 as start, epoch(o_orderdate) // 86400 + o_orderkey % 200 as stop from orders),
p as (select distinct o_custkey as c, epoch(l_shipdate) // 86400 as pt from lineitem join orders on l_orderkey = o_orderkey)"""


def _spans(spark, d):
    orders = table(spark, d, "orders")
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("bigint")
    s = orders.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("span"), day("o_orderdate").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 200).alias("stop"))
    li = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.col("o_custkey").alias("c"), day("l_shipdate").alias("pt")).distinct(), s


@query(
    f"""with {_SPANS}, r as (select p.c, p.pt, span, row_number() over (partition by p.c, p.pt order by stop - start, start, span) as n
    from p join s on p.c = s.c and start <= pt and pt <= stop)
select c, cast(pt as bigint) as pt, span from r where n = 1"""
)
def interval_innermost(spark, d):
    """The smallest span that holds each point."""
    p, s = _spans(spark, d)
    return intervals.innermost(p, s, "c", "pt").where("span is not null")


@query(
    f"""with {_SPANS} select c, span, cast(start as bigint) as start, cast(stop as bigint) as stop from s where exists (select 1 from p where p.c = s.c and pt between start and stop)"""
)
def interval_semi_join(spark, d):
    """Spans that hold at least one point."""
    p, s = _spans(spark, d)
    return intervals.holders(p, s, "c", "pt").select("c", "span", "start", "stop").distinct()


_UNITS = """u as (select l_orderkey as line_order, o_custkey as c, epoch(l_shipdate) // 86400 as first, epoch(l_shipdate) // 86400 + cast(l_quantity as bigint) as last
    from lineitem join orders on l_orderkey = o_orderkey)"""


def _units(spark, d):
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast("bigint")
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return li.select(F.col("l_orderkey").alias("line_order"), F.col("o_custkey").alias("c"), day("l_shipdate").alias("first"), (day("l_shipdate") + F.col("l_quantity").cast("bigint")).alias("last"))


@query(
    f"""with {_SPANS}, {_UNITS}, k as (select distinct c, first, last from u),
r as (select k.*, span, row_number() over (partition by k.c, first, last order by stop - start, start, span) as n from k join s on k.c = s.c and start <= first and last <= stop)
select u.c, line_order, cast(u.first as bigint) as first, cast(u.last as bigint) as last, span from u left join r on u.c = r.c and u.first = r.first and u.last = r.last and n = 1"""
)
def interval_owner(spark, d):
    """The owner of each unit of days: the shortest span that holds it whole, else the top level (null); a unit across two spans is guessed into neither."""
    _, s = _spans(spark, d)
    return intervals.innermost(_units(spark, d), s, "c", "first", "last").select("c", "line_order", "first", "last", "span")


@query(
    f"""with {_SPANS}, {_UNITS}, k as (select distinct c, first, last from u)
select s.c, span, cast(count(*) as bigint) as units from s join k on k.c = s.c and start <= first and last <= stop group by s.c, span"""
)
def interval_units_covered(spark, d):
    """Spans with how many distinct units lie in them whole."""
    _, s = _spans(spark, d)
    return intervals.holders(_units(spark, d), s, "c", "first", "last").groupBy("c", "span").agg(F.count(F.lit(1)).alias("units"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def anti_join(spark, d):
    """Orders of which no line came back."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    return table(spark, d, "orders").join(back, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query(
    """with m as (select distinct l_suppkey as pair, l_partkey as mark from lineitem where l_returnflag = 'R')
select distinct l_suppkey as s, l_partkey as p from lineitem x where l_returnflag = 'A' and exists (select 1 from m where mark = l_partkey and pair <> l_suppkey)"""
)
def provenance_semi_join(spark, d):
    """Supplier and part of accepted lines where another supplier's line of the part came back.

    A part's marks are reduced to their least and greatest supplier, so that the join is one row a part.
    """
    li = table(spark, d, "lineitem")
    marks = li.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p")).agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    x = li.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct()
    return x.join(marks, "p").where("lo <> s or hi <> s").select("s", "p")


_LEGS = """sim as (select distinct least(a.l_partkey, b.l_partkey) as a, greatest(a.l_partkey, b.l_partkey) as b from lineitem a join lineitem b
    on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey),
pos as (select p_partkey as k, p_size as v from part where p_size > 10), churn as (select l_partkey as k, count(*) as n from lineitem where l_tax > 0.07 group by 1)"""


@query(
    f"""with {_LEGS} select a, b, x.v as pos_a, y.v as pos_b, cast(coalesce(u.n, 0) as bigint) as churn_a, cast(coalesce(w.n, 0) as bigint) as churn_b,
    cast(x.v is not null as int) + 2 * cast(y.v is not null as int) as legs
from sim left join pos x on a = x.k left join pos y on b = y.k left join churn u on a = u.k left join churn w on b = w.k"""
)
def outer_leg_join(spark, d):
    """Pairs with optional legs: positions stay null where absent, churn counts as zero."""
    li = table(spark, d, "lineitem")
    parts = li.select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    x, y = parts.alias("x"), parts.alias("y")
    sim = x.join(y, (F.col("x.o") == F.col("y.o")) & (F.col("x.p") < F.col("y.p"))).select(F.col("x.p").alias("a"), F.col("y.p").alias("b")).distinct()
    pos = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("v"))
    churn = li.where("l_tax > 0.07").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    out = sim
    for side in ("a", "b"):
        out = out.join(pos.toDF(side, f"pos_{side}"), side, "left").join(churn.toDF(side, f"churn_{side}"), side, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    legs = F.col("pos_a").isNotNull().cast("int") + 2 * F.col("pos_b").isNotNull().cast("int")
    return out.select("a", "b", "pos_a", "pos_b", zero("churn_a"), zero("churn_b"), legs.alias("legs"))


@query(
    """with t as (select l_partkey as k, max(cast(l_returnflag = 'R' as int)) as r, max(cast(l_quantity >= 50 as int)) as q from lineitem group by 1)
select coalesce(r, 0) + 2 * coalesce(q, 0) as bits, cast(count(*) as bigint) as n, coalesce(r, 0) + 2 * coalesce(q, 0) > 0 as convicted from part left join t on p_partkey = k group by all"""
)
def touched_sets(spark, d):
    """Membership of two touched sets as bits; any convicts."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(
        F.max((F.col("l_returnflag") == "R").cast("int")).alias("r"), F.max((F.col("l_quantity") >= 50).cast("int")).alias("q")
    )
    j = table(spark, d, "part").join(t, F.col("p_partkey") == F.col("k"), "left")
    bits = F.coalesce("r", F.lit(0)) + 2 * F.coalesce("q", F.lit(0))
    return j.groupBy(bits.alias("bits")).agg(F.count(F.lit(1)).alias("n")).withColumn("convicted", F.col("bits") > 0)


# A reference is a customer's market segment and nation; the rungs ask, in order, for a supplier of the nation by balance class, the nation, its region.
@query(
    """with site as (select c_custkey as site, c_nationkey as nation, cast(floor(c_acctbal / 1000) as int) as class from customer),
r1 as (select site, count(distinct s_suppkey) as n, min(s_suppkey) as t from site join supplier on s_nationkey = nation and cast(floor(s_acctbal / 1000) as int) = class group by site),
r2 as (select site, count(distinct s_suppkey) as n, min(s_suppkey) as t from site join supplier on s_nationkey = nation and s_acctbal > 9000 group by site),
r3 as (select site, max(s_suppkey) as t from site join nation on n_nationkey = nation join nation n2 on n2.n_regionkey = nation.n_regionkey join supplier on s_nationkey = n2.n_nationkey and s_acctbal > 9500 group by site)
select site, case when r1.n = 1 then 1 when r1.n > 1 then 1 when r2.n = 1 then 2 when r2.n > 1 then 2 when r3.t is not null then 3 end as rung,
    case when r1.n = 1 then 'resolved' when r1.n > 1 then 'ambiguous' when r2.n = 1 then 'resolved' when r2.n > 1 then 'ambiguous' when r3.t is not null then 'resolved' else 'unresolved' end as outcome,
    case when r1.n = 1 then r1.t when r1.n > 1 then null when r2.n = 1 then r2.t when r2.n > 1 then null else r3.t end as target
from site left join r1 using (site) left join r2 using (site) left join r3 using (site)"""
)
def resolution_ladder(spark, d):
    """Ordered rungs: the first with candidates decides; more than one candidate on a set rung refuses; the last is by precedence.

    Candidates are reduced on the side of the targets first (count and least for each key), so each site meets one row a rung.
    """
    site = table(spark, d, "customer").select(
        F.col("c_custkey").alias("site"), F.col("c_nationkey").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("int").alias("class")
    )
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), F.col("s_nationkey").alias("nation"), "s_acctbal")
    some = lambda df, keys, n: df.groupBy(*keys).agg(F.countDistinct("s").alias(f"n{n}"), F.min("s").alias(f"t{n}"))
    r1 = some(sup.withColumn("class", F.floor(F.col("s_acctbal") / 1000).cast("int")), ["nation", "class"], 1)
    r2 = some(sup.where("s_acctbal > 9000"), ["nation"], 2)
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    best = sup.where("s_acctbal > 9500").join(nation, "nation").groupBy("region").agg(F.max("s").alias("t3"))
    j = site.join(r1, ["nation", "class"], "left").join(r2, "nation", "left").join(nation.join(best, "region"), "nation", "left")
    one, many = lambda n: F.col(f"n{n}") == 1, lambda n: F.col(f"n{n}") > 1
    rung = F.when(one(1) | many(1), 1).when(one(2) | many(2), 2).when(F.col("t3").isNotNull(), 3)
    outcome = F.when(one(1), "resolved").when(many(1), "ambiguous").when(one(2), "resolved").when(many(2), "ambiguous").when(F.col("t3").isNotNull(), "resolved").otherwise("unresolved")
    target = F.when(one(1), F.col("t1")).when(many(1), None).when(one(2), F.col("t2")).when(many(2), None).otherwise(F.col("t3"))
    return j.select("site", rung.alias("rung"), outcome.alias("outcome"), target.alias("target"))


@query(
    """with w as (select distinct doc_id, source, unnest(coalesce(regexp_extract_all(lower(text), '([\\p{L}\\p{N}\\p{M}]+)', 1), [])) as word from documents),
n as (select distinct unnest(coalesce(regexp_extract_all(lower(text), '([\\p{L}\\p{N}\\p{M}]+)', 1), [])) as name from benchmark)
select source, name, cast(count(*) as bigint) as mentions from w join n on word = name where length(name) >= 3 group by all"""
)
def mentions(spark, d):
    """Documents of each source that mention a word of a benchmark item, at word bounds, words of three letters and more: an equi-join of words."""
    from sparkloom.functions import text as tx

    w = table(spark, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(tx.words(F.col("text")))).alias("word"))
    n = table(spark, d, "benchmark").select(F.explode(tx.words(F.col("text"))).alias("name")).where(F.length("name") >= 3).distinct()
    return w.join(n, F.col("word") == F.col("name")).groupBy("source", "name").agg(F.count(F.lit(1)).alias("mentions"))


@query(
    """with a as (select l_suppkey as s, l_partkey as p, l_returnflag as f from lineitem)
select s, p, cast(sum(distinct case f when 'A' then 1 when 'N' then 2 else 4 end) as int) as sources from a group by s, p"""
)
def source_bitmask(spark, d):
    """Union of candidates from three sources, with a bit for each source that names them."""
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"))
    bit = F.when(F.col("f") == "A", 1).when(F.col("f") == "N", 2).otherwise(4)
    return a.groupBy("s", "p").agg(F.bit_or(bit).alias("sources"))


@query(
    """with o as (select o_custkey as c, o_orderkey as k, o_orderdate as t from orders)
select distinct x.c, x.k as a, y.k as b from o x join o y on x.c = y.c and x.k <> y.k and y.t > x.t and y.t <= x.t + interval 10 days"""
)
def window_range_join(spark, d):
    """Orders of a customer that follow another within ten days: bucketed range join."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"), F.unix_timestamp("o_orderdate").alias("t"))
    ten = 10 * 86400
    x = o.select("c", F.col("k").alias("a"), F.col("t").alias("ta"), F.explode(F.array(F.floor(F.col("t") / ten), F.floor(F.col("t") / ten) + 1)).alias("w"))
    y = o.select("c", F.col("k").alias("b"), F.col("t").alias("tb"), F.floor(F.col("t") / ten).alias("w"))
    return x.join(y, ["c", "w"]).where((F.col("a") != F.col("b")) & (F.col("tb") > F.col("ta")) & (F.col("tb") <= F.col("ta") + ten)).select("c", "a", "b").distinct()
