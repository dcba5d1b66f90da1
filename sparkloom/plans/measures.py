"""Queries for counts, statistics, windows, ranks and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import exact
from sparkloom.operators import selection
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_FULL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice"
FULL = _FULL.split(", ")


@query(
    """with c as (select source, lang, count(*) as n from documents group by all),
s as (select source, sum(n) as total, sum(n * n) as squares, count(*) as bins from c group by source)
select source, cast(total as bigint) as total, cast(bins as bigint) as bins,
    cast(case when bins <= 1 then 0 else (1000 * (total * total - squares) * bins) // (total * total * (bins - 1)) end as bigint) as diversity from s"""
)
def entropy_tsallis(spark, d):
    """Normalised Tsallis-2 diversity of languages in each source, in thousandths."""
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    s = c.groupBy("source").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.count(F.lit(1)).alias("bins"))
    return s.select("source", "total", "bins", exact.tsallis_permille(F.col("total"), F.col("squares"), F.col("bins")).alias("diversity"))


@query(
    """with o as (select source, lang, count(*) as o from documents group by all),
r as (select lang, count(*) as r from documents group by lang), t as (select sum(r) as rt from r),
x as (select source, sum(o) as ot from o group by source),
parts as (select source, lang, coalesce(o, 0) as o, r, ot, rt from x cross join r cross join t left join o using (source, lang))
select source, cast(sum((1000 * (o * rt - r * ot) * (o * rt - r * ot)) // (r * rt * ot * ot)) as bigint) as divergence from parts group by source"""
)
def divergence_chi2(spark, d):
    """Chi-square divergence of a source's languages from all documents', in thousandths, each bin rounded down."""
    docs = table(spark, d, "documents").where("source is not null and lang is not null")
    o = docs.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("o"))
    r = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("r"))
    total = r.agg(F.sum("r").alias("rt"))
    x = docs.groupBy("source").agg(F.count(F.lit(1)).alias("ot"))
    bins = x.join(r.join(total), how="cross").join(o, ["source", "lang"], "left").withColumn("o", F.coalesce("o", F.lit(0)))
    # each count is widened before it is multiplied: products of four are beyond 64 bits from some 55,000 documents on
    o, r, rt, ot = (F.col(c).cast("decimal(38,0)") for c in ("o", "r", "rt", "ot"))
    gap, low = o * rt - r * ot, r * rt * ot * ot
    top = F.lit(1000).cast("decimal(4,0)") * gap * gap
    return bins.withColumn("part", ((top - top % low) / low).cast("decimal(38,0)").cast("bigint")).groupBy("source").agg(
        F.sum("part").alias("divergence")
    )


_PAIRS = f"""li as (select distinct l_orderkey as o, l_partkey as p from lineitem),
fit as (select o from li group by o having count(*) <= {{cap}}),
pairs as (select a.p as a, b.p as b, count(*) as n from li a join li b on a.o = b.o and a.p < b.p where a.o in (select o from fit) group by all)"""


def cochange(spark, d, cap: int, floor: int):
    """(a, b, n): parts ordered together at least `floor` times, in orders of at most `cap` parts: each gives a bounded number of pairs."""
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    fit = li.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("o"))).where(F.col("k") <= cap)
    a, b = fit.alias("a"), fit.alias("b")
    pairs = a.join(b, (F.col("a.o") == F.col("b.o")) & (F.col("a.p") < F.col("b.p")))
    n = pairs.groupBy(F.col("a.p").alias("a"), F.col("b.p").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return n.where(F.col("n") >= floor)


@query(f"with {_PAIRS.format(cap=knobs.COMMIT_FILES)} select a, b, cast(n as bigint) as n from pairs where n >= {knobs.COCHANGE_FLOOR}")
def cochange_pairs(spark, d):
    """Parts ordered together twice or more."""
    return cochange(spark, d, knobs.COMMIT_FILES, knobs.COCHANGE_FLOOR)


@query(
    f"""with {_PAIRS.format(cap=5)}, k as (select count(*) as skipped from (select o from li group by o having count(*) > 5))
select a, b, cast(n as bigint) as n, cast(skipped as bigint) as skipped from pairs cross join k"""
)
def cochange_small_orders(spark, d):
    """The same under a cap that bites, with how many orders it skips."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    skipped = li.groupBy("l_orderkey").count().where("count > 5").agg(F.count(F.lit(1)).alias("skipped"))
    return cochange(spark, d, 5, 1).join(skipped, how="cross")


@query(
    f"""with {_PAIRS.format(cap=knobs.COMMIT_FILES)},
t as (select a, b, n from pairs order by n desc, a, b limit 20)
select a, b, cast(n as bigint) as n, cast(greatest((select count(*) from pairs) - 20, 0) as bigint) as rest from t"""
)
def cochange_top(spark, d):
    """The twenty most frequent pairs, and how many more there are."""
    pairs = cochange(spark, d, knobs.COMMIT_FILES, 1)
    rest = pairs.agg(F.greatest(F.count(F.lit(1)) - 20, F.lit(0)).alias("rest"))
    return pairs.orderBy(F.desc("n"), "a", "b").limit(20).join(rest, how="cross")


@query(
    f"""with e as (select l_partkey as part, row_number() over (partition by l_partkey order by o_orderdate, {_FULL}) as n
    from lineitem join orders on l_orderkey = o_orderkey)
select part, cast(count(*) filter (n = 1) as bigint) as appended, cast(count(*) filter (n > 1) as bigint) as rewritten from e group by rollup (part)"""
)
def churn_ledger(spark, d):
    """First and repeated appearances of each part, and their totals."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    n = F.row_number().over(Window.partitionBy("l_partkey").orderBy("o_orderdate", *FULL))
    e = li.select(F.col("l_partkey").alias("part"), n.alias("n"))
    return e.rollup("part").agg(F.count_if(F.col("n") == 1).alias("appended"), F.count_if(F.col("n") > 1).alias("rewritten"))


@query(
    """with d as (select cast(ts as date) as day, count(*) as n, count(*) filter (event_type = 'error') as e from events group by 1)
select day, cast(n as bigint) as n, cast(1000 - (1000 * e) // n as bigint) as score from d"""
)
def daily_scores(spark, d):
    """A score of each day: a thousand less its share of errors."""
    return _days(spark, d).select("day", "n", "score")


def _days(spark, d):
    e = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("e")
    )
    return e.withColumn("score", 1000 - exact.whole(F.lit(1000) * F.col("e"), F.col("n")))


@query(
    f"""with d as (select cast(ts as date) as day, count(*) as n, count(*) filter (event_type = 'error') as e from events group by 1),
s as (select date_diff('day', (select min(day) from d), day) as x, 1000 - (1000 * e) // n as y from d),
m as (select count(*) as n, cast(sum(x) as hugeint) as sx, cast(sum(y) as hugeint) as sy, cast(sum(x * y) as hugeint) as sxy, cast(sum(x * x) as hugeint) as sxx from s)
select cast(n as bigint) as points, case when n < {knobs.MIN_POINTS} or n * sxx = sx * sx then null
    when n * sxy < sx * sy then -1 when n * sxy > sx * sy then 1 else 0 end as direction,
    cast(n * sxy - sx * sy as bigint) as top, cast(n * sxx - sx * sx as bigint) as bottom from m"""
)
def trend_slope(spark, d):
    """Least-squares slope of the daily scores as an exact ratio, and its direction."""
    s = _days(spark, d)
    first = s.agg(F.min("day").alias("first"))
    x = F.datediff("day", "first").cast("bigint")
    m = s.join(first, how="cross").select(x.alias("x"), F.col("score").alias("y")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx")
    )
    top, low = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    sign = F.when((F.col("n") < knobs.MIN_POINTS) | (low == 0), F.lit(None)).otherwise(F.signum(top.cast("double")).cast("int"))
    return m.select(F.col("n").alias("points"), sign.alias("direction"), top.alias("top"), low.alias("bottom"))


@query(
    """with r as (select p_brand as brand, p_size as v, row_number() over (partition by p_brand order by p_size) as rn, count(*) over (partition by p_brand) as n from part)
select brand, cast(sum(v) as bigint) as twice_median_top, cast(count(*) as bigint) as bottom from r where rn in ((n + 1) // 2, (n + 2) // 2) group by brand"""
)
def exact_median(spark, d):
    """Median part size of each brand as a ratio: the sum of the middle one or two over their number."""
    part = table(spark, d, "part").select(F.col("p_brand").alias("brand"), F.col("p_size").alias("v"))
    return selection.medians(part, "brand", "v").select("brand", F.col("top").alias("twice_median_top"), "bottom")


@query(
    f"""with o as (select distinct {_FULL} from lineitem),
w as (select *, lag(l_linenumber) over (partition by l_orderkey order by {_FULL}) as before from o),
i as (select *, sum(case when before is null or l_linenumber - before > 1 then 1 else 0 end) over (partition by l_orderkey order by {_FULL} rows unbounded preceding) as island from w)
select l_orderkey, cast(island as bigint) as island, cast(min(l_linenumber) as int) as first_line, cast(max(l_linenumber) as int) as last_line, cast(count(*) as bigint) as n from i group by all"""
)
def change_runs(spark, d):
    """Islands of adjacent line numbers in each order: a gap test and a running sum."""
    o = table(spark, d, "lineitem").select(*FULL).distinct()
    w = Window.partitionBy("l_orderkey").orderBy(*FULL)
    before = F.lag("l_linenumber").over(w)
    gap = o.withColumn("gap", F.when(before.isNull() | (F.col("l_linenumber") - before > 1), 1).otherwise(0))
    isl = gap.withColumn("island", F.sum("gap").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return isl.groupBy("l_orderkey", "island").agg(
        F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count(F.lit(1)).alias("n")
    )


@query(
    f"""select distinct l_orderkey, l_partkey, l_linenumber, l_suppkey, l_shipdate, l_quantity, l_extendedprice,
    cast(row_number() over (partition by l_orderkey, l_partkey order by {_FULL}) - 1 as int) as nth,
    lead(l_partkey) over (partition by l_orderkey order by {_FULL}) is not null as seam from lineitem"""
)
def ordinals_and_seams(spark, d):
    """The ordinal of a part in its order, and whether another line follows."""
    li = table(spark, d, "lineitem")
    nth = F.row_number().over(Window.partitionBy("l_orderkey", "l_partkey").orderBy(*FULL)) - 1
    seam = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy(*FULL)).isNotNull()
    return li.select(*FULL, nth.alias("nth"), seam.alias("seam")).distinct()


@query(
    """with o as (select o_custkey as c, cast(min(o_orderdate) as date) as a, cast(max(o_orderdate) as date) as b from orders group by 1),
d as (select a as day, 1 as v from o union all select b, -1 from o), s as (select day, sum(v) as v from d group by day)
select day, cast(sum(v) over (order by day rows unbounded preceding) as bigint) as open from s"""
)
def interval_crossings(spark, d):
    """How many customers' order spans cover each day: starts and ends summed by day, then a running sum over days."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b"))
    steps = o.select(F.explode(F.array(F.struct(F.col("a").alias("day"), F.lit(1).alias("v")), F.struct(F.col("b").alias("day"), F.lit(-1).alias("v")))).alias("s"))
    per = steps.groupBy("s.day").agg(F.sum("s.v").alias("v"))  # as many rows as days, whatever the input
    return per.select("day", F.sum("v").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("open"))


@query(
    """with s as (select o_custkey as c, cast(o_orderdate as date) as a, cast(o_orderdate as date) + cast(o_orderkey % 400 as int) as b, o_orderkey as k from orders),
m as (select *, max(b) over (partition by c order by a, b desc, k rows between unbounded preceding and 1 preceding) as seen from s)
select c, a, b, k from m where seen is null or a > seen"""
)
def top_level_spans(spark, d):
    """Spans of a customer that start after all earlier ones have ended."""
    day = F.to_date("o_orderdate")
    s = table(spark, d, "orders").select(
        F.col("o_custkey").alias("c"), day.alias("a"), F.date_add(day, (F.col("o_orderkey") % 400).cast("int")).alias("b"), F.col("o_orderkey").alias("k")
    )
    w = Window.partitionBy("c").orderBy("a", F.desc("b"), "k").rowsBetween(Window.unboundedPreceding, -1)
    return s.withColumn("seen", F.max("b").over(w)).where("seen is null or a > seen").drop("seen")


@query(
    """with s as (select user_id, event_id, ts, event_type, sum(cast(event_type = 'signup' as int)) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from events)
select user_id, event_id, cast(k % 2 as int) as inside from s"""
)
def parity_toggle(spark, d):
    """A state that each sign-up of a user flips, as a running sum modulo two."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    k = F.sum((F.col("event_type") == "signup").cast("int")).over(w)
    return table(spark, d, "events").select("user_id", "event_id", (k % 2).cast("int").alias("inside"))


@query(
    """with a as (select l_partkey as p, sum(l_quantity) as q from lineitem where l_returnflag = 'R' group by 1),
b as (select l_partkey as p, sum(l_quantity) as q from lineitem where l_returnflag = 'N' group by 1)
select 'both' as part, cast(count(*) as bigint) as n from (select p from a intersect select p from b)
union all select 'either', cast(count(*) as bigint) from (select p from a union select p from b)
union all select 'removed', cast(count(*) as bigint) from (select p from a except select p from b)
union all select 'added', cast(count(*) as bigint) from (select p from b except select p from a)"""
)
def set_operations(spark, d):
    """Parts returned and parts not: both, either, and what each has alone."""
    li = table(spark, d, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p")).distinct()
    b = li.where("l_returnflag = 'N'").select(F.col("l_partkey").alias("p")).distinct()
    count = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"))
    return (
        count(a.intersect(b), "both")
        .unionByName(count(a.union(b).distinct(), "either"))
        .unionByName(count(a.subtract(b), "removed"))
        .unionByName(count(b.subtract(a), "added"))
    )


@query(
    """with r as (select s_nationkey as nation, s_suppkey, s_name, cast(round(s_acctbal * 100) as bigint) as cents,
    row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) as rn from supplier)
select nation, string_agg(s_name, ',' order by rn) as top, max(cents) as best from r where rn <= 3 group by nation"""
)
def top_three_message(spark, d):
    """The three first suppliers of each nation as one message."""
    rn = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    r = table(spark, d, "supplier").withColumn("rn", rn).where("rn <= 3")
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "s_name"))), lambda x: x["s_name"]), ",")
    cents = F.round(F.col("s_acctbal") * 100).cast("bigint")
    return r.groupBy(F.col("s_nationkey").alias("nation")).agg(names.alias("top"), F.max(cents).alias("best"))


@query(
    """with t as (select l_suppkey as s, l_partkey as p, cast(sum(l_quantity) as bigint) as q, count(*) as n from lineitem group by all),
r as (select *, row_number() over (partition by s order by cast(q as decimal(38,12)) / n desc, p desc) as rn from t)
select s, p, q, cast(n as bigint) as n from r where rn = 1"""
)
def argmax_ratio(spark, d):
    """The part of the highest mean quantity for each supplier, the last among equals."""
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).agg(
        F.sum("l_quantity").cast("bigint").alias("q"), F.count(F.lit(1)).alias("n")
    )
    ratio = F.col("q").cast("decimal(20,0)") / F.col("n").cast("decimal(10,0)")
    rn = F.row_number().over(Window.partitionBy("s").orderBy(ratio.desc(), F.desc("p")))
    return t.withColumn("rn", rn).where("rn = 1").drop("rn")


@query(
    """select l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) as g, cast(count(*) as bigint) as n,
    cast(count(*) filter (l_quantity > 25) as bigint) as large from lineitem group by cube (l_returnflag, l_linestatus)"""
)
def site_counts_cube(spark, d):
    """Counts by two keys with all margins."""
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("large")
    )
