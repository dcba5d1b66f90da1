"""Queries over lines under a state, exempt blocks of lines, and seams of files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkloom import knobs
from sparkloom.operators import graph, linestates, seams
from sparkloom.plans.registry import query
from sparkloom.sources.tables import dealt, table


@query()
def line_states(spark, d):
    """Every document's and page's lines: those in fences, characters of comments and code, and what stays visible, with a 64-bit hash over
    lines and their places. A text without lines has no row."""
    docs = dealt(spark, d, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    pages = dealt(spark, d, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))
    seen = linestates.masked_lines(linestates.stretches(docs.unionByName(pages), ["kind", "id"], "text"), ["kind", "id"])
    shown = F.length(F.replace("visible", F.lit(" "), F.lit("")))
    # lines are folded to a number of 64 bits each before they are dealt out, so a text of any length is a few sums
    return seen.groupBy("kind", "id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if("fenced").alias("fenced"),
        F.sum("comment").alias("comment"),
        F.sum("code").alias("code"),
        F.sum(shown).alias("visible"),
        F.bit_xor(F.xxhash64("line", "visible")).alias("shown_hash"),
    )


_RE = {"fence": linestates.FENCE_LINE.replace("'", "''"), "form": linestates.FORM_LINE.replace("'", "''")}
_HEADER_SQL = " or ".join(f"contains(line, '{m}')" for m in linestates.HEADER_MARKS)
_ALLOW_RE = linestates.ALLOW_MARK.replace("(", "[(]").replace(")", "[)]") + ".*?--.*[^ \\t\\n\\f\\r]"
_BLOCKS = f"""ln as (select doc_id, unnest(arr) as line, generate_subscripts(arr, 1) as i from
    (select doc_id, string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)) as arr from documents)),
bl as (select *, sum(cast(not regexp_matches(line, '[^\\s]') as int)) over (partition by doc_id order by i) as g from ln),
fl as (select *, regexp_matches(line, '{_RE["fence"]}') as opens from bl where regexp_matches(line, '[^\\s]')),
st as (select *, opens or sum(cast(opens as int)) over (partition by doc_id, g order by i) % 2 = 1 as fenced, g = min(g) over (partition by doc_id) as head from fl),
kd as (select *, case when fenced then 'fenced' when regexp_matches(line, '{_RE["form"]}') then 'form' when length(trim(line)) > {linestates.LINE_CAP} then 'overlong' else 'kept' end as k from st),
cl as (select doc_id, g, case when bool_or(head) and min(i) <= {linestates.HEADER_LINES} and bool_or({_HEADER_SQL}) then 'license_header'
        when bool_or(regexp_matches(line, '{_ALLOW_RE}')) then 'inline_allow' when bool_or(contains(line, '{linestates.ALLOW_MARK}')) then 'allow_missing_why' else 'live' end as exempt,
    count(*) filter (k = 'fenced') as fenced_code, count(*) filter (k = 'form') as form, count(*) filter (k = 'overlong') as overlong, count(*) filter (k = 'kept') as kept
    from kd group by doc_id, g)"""


def _blocks(spark, d):
    rows = linestates.blocks(dealt(spark, d, "documents"), "doc_id", "text")
    return rows.select("doc_id", linestates.exemption(F.col("block"), F.col("start"), F.col("body")).alias("exempt"), linestates.stripped(F.col("body")).alias("s"))


@query(
    f"""with {_BLOCKS} select doc_id, cast(count(*) as bigint) as blocks, cast(count(*) filter (exempt in ('license_header', 'inline_allow')) as bigint) as exempted,
    cast(count(*) filter (exempt = 'allow_missing_why') as bigint) as without_reason, cast(sum(fenced_code) as bigint) as fenced_code, cast(sum(form) as bigint) as form,
    cast(sum(overlong) as bigint) as overlong, cast(sum(kept) as bigint) as kept from cl group by doc_id"""
)
def line_ledger(spark, d):
    """Every line that judging sheds, by why: exempt blocks, allow marks without a reason, fenced code, lines of a form, overlong lines; and those kept."""
    total = lambda c: F.sum(f"s.{c}").alias(c)
    return _blocks(spark, d).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_if(F.col("exempt").isin("license_header", "inline_allow")).alias("exempted"),
        F.count_if(F.col("exempt") == "allow_missing_why").alias("without_reason"),
        total("fenced_code"),
        total("form"),
        total("overlong"),
        F.sum(F.size("s.kept")).alias("kept"),
    )


@query(f"with {_BLOCKS} select exempt, cast(count(*) as bigint) as n, cast(sum(kept) as bigint) as kept from cl group by exempt")
def block_exemptions(spark, d):
    """Blocks of lines by why they are exempt from judgement, and how many of their lines are prose."""
    return _blocks(spark, d).groupBy("exempt").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("s.kept")).alias("kept"))


_P = f"""case when %s <= {knobs.SOFT} then 0 when %s <= {knobs.HARD} then {knobs.ZONE_MAX} * (%s - {knobs.SOFT}) * (%s - {knobs.SOFT})
    else {knobs.ZONE_MAX} * ({(knobs.HARD - knobs.SOFT) ** 2} + {2 * (knobs.HARD - knobs.SOFT)} * (%s - {knobs.HARD})) end"""
_p = lambda x: _P.replace("%s", x)


@query(
    f"""with o as (select o_custkey as f, o_orderkey as u, any_value(o_orderpriority) as pr, any_value(o_orderstatus) as os, cast(sum(l_quantity) as bigint) as w
    from orders join lineitem on l_orderkey = o_orderkey group by all),
u as (select *, sum(w) over (partition by f order by u) as e, sum(w) over (partition by f) as total, max(u) over (partition by f) as last from o),
rf as (select * from (select f, u as a, lead(u) over (partition by f, pr order by u) as b from u) where b is not null),
ch as (select * from (select f, u as a, lead(u) over (partition by f, os order by u) as b from u) where b is not null),
cn as (select f, l_suppkey, min(e - w) as s, max(e) as e from u join lineitem on l_orderkey = u group by all having count(distinct u) >= 2),
sm as (select f, u, e, total from u where u < last),
c1 as (select f, u, count(*) as n from sm join rf using (f) where a <= u and u < b group by all),
c2 as (select f, u, count(*) as n from sm join ch using (f) where a <= u and u < b group by all),
c3 as (select sm.f, sm.u, count(*) as n from sm join cn on cn.f = sm.f and cn.s <= sm.e and sm.e < cn.e group by all),
pr as (select f, u, cast(greatest(0, ({_p('total')}) - ({_p('e')}) - ({_p('(total - e)')})) * 1000 // {(knobs.HARD - knobs.SOFT) ** 2} as bigint) as benefit,
    cast({knobs.SPLIT_REF} * coalesce(c1.n, 0) + {knobs.SPLIT_CHURN} * coalesce(c2.n, 0) + {knobs.SPLIT_CLONE} * coalesce(c3.n, 0) + {knobs.SPLIT_FILE} as bigint) as cost
    from sm left join c1 using (f, u) left join c2 using (f, u) left join c3 using (f, u)),
bt as (select p.* from pr p where not exists (select 1 from pr q where q.f = p.f and
    (q.benefit * p.cost > p.benefit * q.cost or (q.benefit * p.cost = p.benefit * q.cost and q.u > p.u))))
select f as file, bt.u as unit, coalesce(benefit, 0) as benefit, coalesce(cost, 0) as cost, coalesce(benefit < cost, true) as exempt from (select distinct f from u) left join bt using (f)"""
)
def split_gain(spark, d):
    """Each customer's orders as units of a file: the seam that saves most for what it severs (orders of one priority or status in a row) and cuts (a supplier's
    stretch), and whether it pays."""
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("unit")).agg(F.sum("l_quantity").cast("bigint").alias("w"))
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("unit"), "o_orderpriority", "o_orderstatus")
    sized = graph.settle(orders.join(lines, "unit"))
    ends = seams.running(sized, "file", "unit", "w").withColumnRenamed("total", "end")
    units = graph.settle(ends.join(sized.select("file", "unit", "w"), ["file", "unit"]))
    follow = lambda c: sized.select("file", F.col("unit").alias("a"), F.lead("unit").over(Window.partitionBy("file", c).orderBy("unit")).alias("b"))
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("unit"), "l_suppkey").join(units, "unit")
    spans = parts.groupBy("file", "l_suppkey").agg(F.min(F.col("end") - F.col("w")).alias("s"), F.max("end").alias("e"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    return seams.split_gains(units.select("file", "unit", "end"), follow("o_orderpriority"), spans.where("lo < hi").select("file", "s", "e"), follow("o_orderstatus"))
