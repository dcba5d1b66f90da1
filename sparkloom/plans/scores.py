"""Queries for grades, charges, scores, soft lines and ratchets, in whole numbers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import exact
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_GRADE_SQL = ", ".join(f"({c}, {w}, {f})" for c, w, f in knobs.GRADES)
_MEASURES = """m as (select doc_id, 0 as code, cast(n_chars as bigint) as v from documents
    union all select doc_id, 1, cast(len(string_split(coalesce(text, ''), chr(10))) as bigint) from documents
    union all select doc_id, 2, cast(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '!', '')) as bigint) from documents)"""


def _measures(spark, d):
    t = F.coalesce("text", F.lit(""))
    rows = F.array(
        *(
            F.struct(F.lit(code).alias("code"), v.cast("bigint").alias("v"))
            for code, v in (
                (0, F.col("n_chars")),
                (1, F.size(F.split(t, "\n", -1))),
                (2, F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))),
            )
        )
    )
    return table(spark, d, "documents").select("doc_id", F.explode(rows).alias("m")).select("doc_id", "m.code", "m.v")


def _graded(spark, d):
    grades = spark.createDataFrame(knobs.GRADES, "code int, warn bigint, fail bigint")
    m = _measures(spark, d).join(F.broadcast(grades), "code")  # a fixed table of seven rows
    level = F.when((F.col("fail") > 0) & (F.col("v") > F.col("fail")), 2).when(F.col("v") > F.col("warn"), 1).otherwise(0)
    return m.withColumn("level", level)


_GRADED = f"""{_MEASURES}, g(code, warn, fail) as (values {_GRADE_SQL}),
x as (select doc_id, code, v, case when fail > 0 and v > fail then 2 when v > warn then 1 else 0 end as level from m join g using (code))"""


@query(f"with {_GRADED} select doc_id, code, v, level from x where level > 0")
def metric_grades(spark, d):
    """Measures of documents over their warning or hard lines."""
    return _graded(spark, d).where("level > 0").select("doc_id", "code", "v", "level")


@query(
    f"""with {_GRADED} select code, cast(count(*) as bigint) as n, cast(count(*) filter (level = 1) as bigint) as warned,
    cast(count(*) filter (level = 2) as bigint) as failed, bool_or(level = 2) as fails from x group by code"""
)
def grade_summary(spark, d):
    """Counters of every measure and its pass or fail."""
    return _graded(spark, d).groupBy("code").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == 1).alias("warned"), F.count_if(F.col("level") == 2).alias("failed"), F.bool_or(F.col("level") == 2).alias("fails")
    )


_SOURCE = """s as (select source, count(*) as n, count(*) filter (n_chars > 750) as large, count(*) filter (n_chars <= 300) as small,
    count(*) - count(distinct text) as copies from documents group by source)"""


def _sources(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("n_chars") > knobs.HARD).alias("large"),
        F.count_if(F.col("n_chars") <= knobs.SOFT).alias("small"),
        (F.count(F.lit(1)) - F.countDistinct("text")).alias("copies"),
    )


def _charge_sql(v: str, n: str) -> str:
    return f"case when {v} + {n} > 0 then ({knobs.SCALE} * {v}) // ({v} + {n}) else 0 end"


@query(
    f"""with {_SOURCE}, c as (select source, {_charge_sql('large', 'n')} as size_charge, {_charge_sql('copies', 'n')} as copy_charge, {_charge_sql('small', 'n')} as small_charge from s)
select source, cast(size_charge as bigint) as size_charge, cast(copy_charge as bigint) as copy_charge, cast(small_charge as bigint) as small_charge,
    cast(greatest(0, {knobs.SCALE} - ({knobs.NEUTRAL_COST} * (size_charge + copy_charge + small_charge)) // ({knobs.NEUTRAL_COST} * 3)) as bigint) as score from c"""
)
def source_scores(spark, d):
    """Density charges of three axes for each source and their weighted score."""
    c = _sources(spark, d).select(
        "source",
        exact.charge(knobs.SCALE, F.col("large"), F.col("n")).alias("size_charge"),
        exact.charge(knobs.SCALE, F.col("copies"), F.col("n")).alias("copy_charge"),
        exact.charge(knobs.SCALE, F.col("small"), F.col("n")).alias("small_charge"),
    )
    raw = F.lit(knobs.NEUTRAL_COST) * (F.col("size_charge") + F.col("copy_charge") + F.col("small_charge"))
    fold = F.lit(knobs.SCALE) - exact.whole(raw, F.lit(knobs.NEUTRAL_COST * 3))
    return c.withColumn("score", F.greatest(F.lit(0).cast("bigint"), fold))


@query(
    f"""select doc_id, n_chars, case when n_chars <= {knobs.SOFT} then 0 when n_chars <= {knobs.HARD} then
    (n_chars - {knobs.SOFT}) * (n_chars - {knobs.SOFT}) * {knobs.ZONE_MAX} else
    {knobs.ZONE_MAX} * ({knobs.HARD - knobs.SOFT} * {knobs.HARD - knobs.SOFT} + 2 * {knobs.HARD - knobs.SOFT} * (n_chars - {knobs.HARD})) end as penalty,
    case when n_chars <= {knobs.SOFT} then 'free' when n_chars <= {knobs.HARD} then 'soft' else 'hard' end as zone,
    cast(case when n_chars > {knobs.SOFT} and n_chars <= {knobs.HARD} then ((n_chars - {knobs.SOFT}) * 1000) // {knobs.HARD - knobs.SOFT} end as bigint) as permille from documents"""
)
def zone_penalties(spark, d):
    """Penalty over the common denominator (hard - soft) squared: none, quadratic, then straight with the same slope."""
    v, width = F.col("n_chars"), knobs.HARD - knobs.SOFT
    over = v - knobs.SOFT
    penalty = F.when(v <= knobs.SOFT, 0).when(v <= knobs.HARD, over * over * knobs.ZONE_MAX).otherwise(
        (F.lit(width * width) + 2 * width * (v - knobs.HARD)) * knobs.ZONE_MAX
    )
    zone = F.when(v <= knobs.SOFT, "free").when(v <= knobs.HARD, "soft").otherwise("hard")
    part = F.when((v > knobs.SOFT) & (v <= knobs.HARD), exact.whole(over * 1000, F.lit(width)))
    return table(spark, d, "documents").select("doc_id", "n_chars", penalty.alias("penalty"), zone.alias("zone"), part.alias("permille"))


_CUT = "timestamp '1997-01-01'"
_BASE = f"""base as (select o_custkey as k, count(*) as v from orders where o_orderdate < {_CUT} group by 1),
cur as (select o_custkey as k, count(*) as v from orders where o_orderdate >= {_CUT} group by 1)"""
_TOLERATED = "greatest((b.v * 102) // 100, b.v + 10)"


def _two(spark, d):
    orders = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.expr(_CUT)
    count = lambda x: x.groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return count(orders.where(early)), count(orders.where(~early))


@query(
    f"""with {_BASE} select c.k, cast(b.v as bigint) as ceiling, cast(c.v as bigint) as value, cast({_TOLERATED} as bigint) as tolerated,
    coalesce(c.v > {_TOLERATED}, false) as is_over, cast(least(b.v, c.v) as bigint) as next_ceiling from cur c left join base b using (k)"""
)
def ratchet_continuous(spark, d):
    """Current values against their tolerated ceilings, and the ceiling that holds next; one without a baseline is free."""
    base, cur = _two(spark, d)
    j = cur.withColumnRenamed("v", "value").join(base.withColumnRenamed("v", "ceiling"), "k", "left")
    num, den = knobs.TOLERANCE
    tolerated = F.greatest(exact.whole(F.col("ceiling") * num, F.lit(den)), F.col("ceiling") + knobs.TOLERANCE_ABS)
    tolerated = F.when(F.col("ceiling").isNotNull(), tolerated)
    return j.select(
        "k", "ceiling", "value", tolerated.alias("tolerated"), F.coalesce(F.col("value") > tolerated, F.lit(False)).alias("is_over"), F.least("ceiling", "value").alias("next_ceiling")
    )


@query(
    f"""with {_BASE} select 'added' as change, k from (select k from cur except select k from base)
union all select 'removed', k from (select k from base except select k from cur)"""
)
def ratchet_discrete(spark, d):
    """Members that are new, and those that are gone."""
    base, cur = _two(spark, d)
    added = cur.join(base, "k", "left_anti").select(F.lit("added").alias("change"), "k")
    return added.unionByName(base.join(cur, "k", "left_anti").select(F.lit("removed").alias("change"), "k"))


@query(
    f"""with {_BASE}, o as (select count(*) as n_over from cur c join base b using (k) where c.v > {_TOLERATED}),
n as (select count(*) as added from (select k from cur except select k from base)),
f as (select 1000 - (1000 * count(*) filter (o_orderstatus = 'F')) // count(*) as score from orders)
select array_to_string(list_filter([case when n_over > 0 then 'ratchet_over' end, case when added > 0 then 'discrete_added' end, case when score < 500 then 'floor' end], lambda x: x is not null), ',') as held,
    n_over > 0 or added > 0 or score < 500 as fails, cast(score as bigint) as score from o, n, f"""
)
def fail_composition(spark, d):
    """The pass or fail bit, and the names of the conditions that hold."""
    base, cur = _two(spark, d)
    over = ratchet_continuous(spark, d).agg(F.count_if("is_over").alias("n_over"))
    added = cur.join(base, "k", "left_anti").agg(F.count(F.lit(1)).alias("added"))
    score = table(spark, d, "orders").agg(
        (1000 - exact.whole(F.lit(1000) * F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1)))).alias("score")
    )
    names = {"ratchet_over": F.col("n_over") > 0, "discrete_added": F.col("added") > 0, "floor": F.col("score") < 500}
    held = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in names.items())))
    one = over.join(added, how="cross").join(score, how="cross")
    return one.select(F.array_join(held, ",").alias("held"), (F.size(held) > 0).alias("fails"), "score")


@query(
    """with p as (select l_partkey as k, count(*) as churn, max(l_quantity) as q from lineitem group by 1),
s as (select p_partkey as k, p_size >= 40 as big, p_retailprice >= 1500 as dear, coalesce(churn, 0) as churn, coalesce(q, 0) >= 49 as heavy from part left join p on k = p_partkey)
select k, cast(big as int) + 2 * cast(dear as int) + 4 * cast(heavy as int) as reasons,
    case when big and dear and heavy then 'all' when big and churn >= 30 then 'big_and_busy' when dear and heavy then 'dear_and_heavy' when big or dear or heavy then 'single' else 'none' end as verdict from s"""
)
def signal_lattice(spark, d):
    """Reasons as bits, and the first rule that matches in order."""
    p = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("churn"), F.max("l_quantity").alias("q"))
    s = table(spark, d, "part").withColumnRenamed("p_partkey", "k").join(p, "k", "left")
    big, dear = F.col("p_size") >= 40, F.col("p_retailprice") >= 1500
    heavy, churn = F.coalesce("q", F.lit(0.0)) >= 49, F.coalesce("churn", F.lit(0))
    bits = big.cast("int") + 2 * dear.cast("int") + 4 * heavy.cast("int")
    rule = (
        F.when(big & dear & heavy, "all").when(big & (churn >= 30), "big_and_busy").when(dear & heavy, "dear_and_heavy").when(big | dear | heavy, "single").otherwise("none")
    )
    return s.select("k", bits.alias("reasons"), rule.alias("verdict"))


@query(
    """with d as (select doc_id, md5(coalesce(text, '')) as h, n_chars from documents),
k as (select *, count(*) over (partition by h) as n, min(doc_id) over (partition by h) as keeper from d)
select doc_id, case when n = 1 then 'unique' when doc_id = keeper then 'keeper' when n_chars < 20 then 'too_small' else 'erase' end as reason from k"""
)
def erase_plan(spark, d):
    """Which copies may go, and the first fact that forbids it. The keeper comes from a partial aggregate, not a window over copies."""
    x = table(spark, d, "documents").select("doc_id", "n_chars", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    g = x.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"))
    reason = F.when(F.col("n") == 1, "unique").when(F.col("doc_id") == F.col("keeper"), "keeper").when(F.col("n_chars") < 20, "too_small").otherwise("erase")
    return x.join(g, "h").select("doc_id", reason.alias("reason"))


@query(
    """with o as (select o_orderkey, o_custkey % 7 = 0 as a, o_orderpriority = '1-URGENT' as b, o_totalprice > 400000 as c from orders)
select min(o_orderkey) as first_offender, min_by(case when not a then 'no_a' when not b then 'no_b' else 'no_c' end, o_orderkey) as message, cast(count(*) as bigint) as offenders
from o where not (a and b and c)"""
)
def first_offender(spark, d):
    """The first row that breaks a contract, what it breaks, and how many do."""
    a, b, c = F.col("o_custkey") % 7 == 0, F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") > 400000
    bad = table(spark, d, "orders").where(~(a & b & c)).withColumn("m", F.when(~a, "no_a").when(~b, "no_b").otherwise("no_c"))
    return bad.agg(F.min("o_orderkey").alias("first_offender"), F.min_by("m", "o_orderkey").alias("message"), F.count(F.lit(1)).alias("offenders"))
