"""Queries over before and after: moved lines, stacking, relocations, merges of marks; identities and histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import exact
from sparkloom.operators import selection, wholeruns
from sparkloom.operators.similarity import capped_pairs
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_TURNS = """t as (select conv_id, turn, unnest(range(0, len(l))) as p, unnest(l) as line from (
    select conv_id, turn, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)) as l from conversations)),
w as (select *, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) as width from t)"""


def _turn_lines(spark, d):
    t = table(spark, d, "conversations").select(
        "conv_id", "turn", F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x))).alias("p", "line")
    )
    width = F.length(F.regexp_replace("line", r"[^\p{L}\p{N}]", ""))
    return t.withColumn("p", F.col("p").cast("bigint")).withColumn("width", width)


_DOC_LINES = """t as (select doc_id as doc, unnest(range(0, len(l))) as p, unnest(l) as line from (
    select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)) as l from documents)),
w as (select *, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) as width from t)"""


@query(
    f"""with {_DOC_LINES}, r as (select *, row_number() over (partition by line order by doc, p) as rn, count(*) over (partition by line) as g from w where width > 0),
hit as (select a.doc as a, b.doc as b, a.p as pa, b.p as pb, a.width, a.line from r a join r b
    on a.line = b.line and a.rn < b.rn and (a.g <= {knobs.HOT_CAP} or b.rn = a.rn + 1) and a.doc < b.doc),
isl as (select *, pb - pa as lane, pa - row_number() over (partition by a, b, pb - pa order by pa) as i from hit)
select a, b, cast(min(pa) as bigint) as pa, cast(min(pb) as bigint) as pb, cast(count(*) as bigint) as n, cast(max(width) as bigint) as widest,
    count(distinct line) >= {knobs.MOVE_LINES} and max(width) >= {knobs.MOVE_ANCHOR} as is_block from isl group by a, b, lane, i"""
)
def moved_blocks(spark, d):
    """Runs of equal lines between documents; two distinct lines and one wide anchor make a block. Lines in many documents are chained."""
    return _moved(spark, d, capped_pairs)


def _lines(spark, d):
    t = table(spark, d, "documents").select(
        F.col("doc_id").alias("doc"), F.posexplode(F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x))).alias("p", "line")
    )
    width = F.length(F.regexp_replace("line", r"[^\p{L}\p{N}]", ""))
    return t.select("doc", F.col("p").cast("bigint").alias("p"), F.md5(F.col("line").cast("binary")).alias("h"), width.alias("width")).where("width > 0")


def _moved(spark, d, paired):
    keyed = _lines(spark, d)
    hit = paired(keyed, "h", ["doc", "p"]).where("a.doc < b.doc").select(
        F.col("a.doc").alias("a"), F.col("b.doc").alias("b"), F.col("a.p").alias("pa"), F.col("b.p").alias("pb"), F.col("a.width").alias("width"), F.col("a.h").alias("h")
    )
    lane = hit.withColumn("lane", F.col("pb") - F.col("pa"))
    i = F.col("pa") - F.row_number().over(Window.partitionBy("a", "b", "lane").orderBy("pa"))
    return lane.withColumn("i", i).groupBy("a", "b", "lane", "i").agg(
        F.min("pa").alias("pa"),
        F.min("pb").alias("pb"),
        F.count(F.lit(1)).alias("n"),
        F.max("width").cast("bigint").alias("widest"),
        ((F.countDistinct("h") >= knobs.MOVE_LINES) & (F.max("width") >= knobs.MOVE_ANCHOR)).alias("is_block"),
    ).drop("lane", "i")


@query(
    f"""with {_DOC_LINES}, r as (select *, row_number() over (partition by line order by doc, p) as rn from w where width > 0),
hit as (select a.doc as a, b.doc as b, a.p as pa, b.p as pb, a.width, a.line from r a join r b on a.line = b.line and a.rn < b.rn and a.doc < b.doc),
isl as (select *, pb - pa as lane, pa - row_number() over (partition by a, b, pb - pa order by pa) as i from hit)
select a, b, cast(min(pa) as bigint) as pa, cast(min(pb) as bigint) as pb, cast(count(*) as bigint) as n, cast(max(width) as bigint) as widest,
    count(distinct line) >= {knobs.MOVE_LINES} and max(width) >= {knobs.MOVE_ANCHOR} as is_block from isl group by a, b, lane, i"""
)
def moved_blocks_whole(spark, d):
    """Runs of equal lines with all places of every line paired: no run breaks at a common line. Quadratic in a line's places."""
    return wholeruns.line_runs(_lines(spark, d), knobs.MOVE_LINES, knobs.MOVE_ANCHOR)


@query(
    f"""with {_TURNS}, c as (select conv_id, turn, count(*) filter (width > 0) as n, count(distinct line) filter (width > 0) as kinds from w group by all),
p as (select conv_id, turn, n, kinds, n - lag(n) over (partition by conv_id order by turn) as grown from c)
select conv_id, turn, cast(n as bigint) as n, cast(n - kinds as bigint) as repeated, coalesce(n > kinds and grown >= 2, false) as stacked from p"""
)
def stacking_suspicion(spark, d):
    """Turns that repeat a line of their own while they grow."""
    c = _turn_lines(spark, d).groupBy("conv_id", "turn").agg(
        F.count_if(F.col("width") > 0).alias("n"), F.countDistinct(F.when(F.col("width") > 0, F.col("line"))).alias("kinds")
    )
    grown = F.col("n") - F.lag("n").over(Window.partitionBy("conv_id").orderBy("turn"))
    stacked = (F.col("n") > F.col("kinds")) & (grown >= 2)
    return c.select("conv_id", "turn", "n", (F.col("n") - F.col("kinds")).alias("repeated"), F.coalesce(stacked, F.lit(False)).alias("stacked"))


@query(
    """with a as (select l_partkey as unit, l_suppkey as at_unit, count(*) as n from lineitem where l_shipdate < timestamp '1998-01-01' group by all),
b as (select l_partkey as unit, l_suppkey as at_unit, count(*) as n from lineitem where l_shipdate >= timestamp '1998-01-01' group by all)
select a.at_unit as from_unit, b.at_unit as to_unit, cast(sum(least(a.n, b.n)) as bigint) as lines, cast(count(*) as bigint) as units
from a join b using (unit) where a.at_unit <> b.at_unit group by all"""
)
def relocations(spark, d):
    """What moved from which supplier to which, between any two suppliers, with counts."""
    li = table(spark, d, "lineitem")
    early = F.col("l_shipdate") < F.expr("timestamp '1998-01-01'")
    side = lambda rows, x: rows.groupBy(F.col("l_partkey").alias("unit"), F.col("l_suppkey").alias(x)).agg(F.count(F.lit(1)).alias(f"n_{x}"))
    a, b = side(li.where(early), "from_unit"), side(li.where(~early), "to_unit")
    j = a.join(b, "unit").where("from_unit <> to_unit")
    return j.groupBy("from_unit", "to_unit").agg(F.sum(F.least("n_from_unit", "n_to_unit")).alias("lines"), F.count(F.lit(1)).alias("units"))


@query(
    """with m as (select distinct l_orderkey as k from lineitem where l_returnflag = 'R' and l_quantity > 30)
select case when o_orderstatus = 'F' and m.k is not null then 'moved' when o_orderstatus = 'F' then 'plain' else 'other' end as class, m.k is not null and o_orderstatus <> 'F' as refused, cast(count(*) as bigint) as n
from orders left join m on o_orderkey = k group by all"""
)
def delta_merge(spark, d):
    """Marks turn plain rows into moved ones, once; a mark on any other row is refused and counted."""
    m = table(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 30").select(F.col("l_orderkey").alias("k")).distinct()
    j = table(spark, d, "orders").join(m, F.col("o_orderkey") == F.col("k"), "left")
    marked, plain = F.col("k").isNotNull(), F.col("o_orderstatus") == "F"
    kind = F.when(plain & marked, "moved").when(plain, "plain").otherwise("other")
    return j.groupBy(kind.alias("class"), (marked & ~plain).alias("refused")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with p as (select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem),
g as (select md5(a || chr(1) || b) as id, count(*) as n from p group by 1)
select id, cast(n as bigint) as n, cast(n - 1 as bigint) as collapsed from g where n >= 3"""
)
def order_free_ids(spark, d):
    """Identities of unordered pairs, and how many rows collapse into each."""
    a, b = F.least("l_partkey", "l_suppkey"), F.greatest("l_partkey", "l_suppkey")
    key = F.concat(a.cast("string"), F.lit("\x01"), b.cast("string")).cast("binary")
    g = table(spark, d, "lineitem").groupBy(F.md5(key).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return g.where("n >= 3").withColumn("collapsed", F.col("n") - 1)


@query(
    """with p as (select distinct least(a.l_suppkey, b.l_suppkey) as a, greatest(a.l_suppkey, b.l_suppkey) as b from lineitem a join lineitem b
    on a.l_orderkey = b.l_orderkey and a.l_partkey = b.l_partkey)
select cast(count(*) filter (a = b) as bigint) as self_pairs, cast(count(*) filter (a <> b) as bigint) as pairs from p"""
)
def canonical_pairs(spark, d):
    """Distinct unordered supplier pairs that share a part of an order; pairs with oneself are counted apart."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", F.col("l_suppkey").alias("s")).distinct()
    x, y = li.withColumnRenamed("s", "x"), li.withColumnRenamed("s", "y")
    p = x.join(y, ["l_orderkey", "l_partkey"]).where("x <= y").select("x", "y").distinct()
    return p.agg(F.count_if(F.col("x") == F.col("y")).alias("self_pairs"), F.count_if(F.col("x") != F.col("y")).alias("pairs"))


@query(
    """with t as (select page_id, unnest(regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1)) as tag from pages)
select page_id, tag, cast(count(*) as bigint) as n from t group by all"""
)
def tag_histogram(spark, d):
    """Kinds of elements of each page, counted."""
    tags = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.explode(tags).alias("tag")).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    """with t as (select page_id, regexp_extract_all(lower(html), '<([a-z][a-z0-9]*)', 1) as g from pages),
s as (select distinct page_id, array_to_string(g[i : i + 3], ' ') as h from t, unnest(range(1, len(g) - 2)) as x(i)),
k as (select h, count(*) as pages from s group by h)
select h, cast(pages as bigint) as pages from k where pages >= 2"""
)
def structural_shingles(spark, d):
    """Runs of four element kinds that two pages or more share."""
    g = F.regexp_extract_all(F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))
    runs = F.transform(F.sequence(F.lit(1), F.size("g") - 3), lambda i: F.array_join(F.slice("g", i, F.lit(4)), " "))
    s = table(spark, d, "pages").select("page_id", g.alias("g")).where(F.size("g") >= 4).select("page_id", F.explode(F.array_distinct(runs)).alias("h"))
    return s.groupBy("h").agg(F.count(F.lit(1)).alias("pages")).where("pages >= 2")


@query(
    """with t as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[0-9]+', '#', 'g'), '"[^"]*"', '""', 'g') as n from documents)
select md5(n) as id, cast(count(*) as bigint) as docs, min(doc_id) as first_doc, cast(max(length(n) - length(replace(n, '#', ''))) as bigint) as literals from t group by n having count(*) >= 2"""
)
def normalised_texts(spark, d):
    """Texts that are equal once numbers and quoted strings are folded."""
    n = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[0-9]+", "#"), '"[^"]*"', '""')
    t = table(spark, d, "documents").select("doc_id", n.alias("n"))
    lit = F.length("n") - F.length(F.replace("n", F.lit("#"), F.lit("")))
    rows = t.select("doc_id", F.md5(F.col("n").cast("binary")).alias("id"), lit.cast("bigint").alias("lit"))
    g = rows.groupBy("id").agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first_doc"), F.max("lit").alias("literals"))
    return g.where("docs >= 2")


_SOFT_K, _SOFT_CLAMP = 2, (1500, 6000)


@query(
    f"""with r as (select source as k, cast(n_chars as hugeint) as v from documents where n_chars > 0),
m as (select k, v, row_number() over (partition by k order by v) as n, count(*) over (partition by k) as c from r),
med as (select k, sum(v) as m2, count(*) as d from m where n in ((c + 1) // 2, (c + 2) // 2) group by k),
ratio as (select k, greatest(v * d, m2) as p, least(v * d, m2) as q from r join med using (k)),
o as (select *, row_number() over (partition by k order by cast(p as decimal(38,20)) / q, p, q) as n, count(*) over (partition by k) as c from ratio),
two as (select k, min(p) filter (n = (c + 1) // 2) as p, min(q) filter (n = (c + 1) // 2) as q, min(p) filter (n = (c + 2) // 2) as p2, min(q) filter (n = (c + 2) // 2) as q2 from o group by k),
line as (select k, (m2 * (p * q2 + p2 * q) * (p * q2 + p2 * q)) // (d * (2 * q * q2) * (2 * q * q2)) as s from two join med using (k))
select k, cast(least(greatest(s, {_SOFT_CLAMP[0]}), {_SOFT_CLAMP[1]}) as bigint) as soft from line"""
)
def soft_lines(spark, d):
    """A soft line for the length of each source's documents: median times the squared median ratio to it, rounded down and clamped, in whole numbers."""
    return selection.soft_lines(table(spark, d, "documents").withColumnRenamed("source", "k"), "k", "n_chars", _SOFT_K, *_SOFT_CLAMP)


# Kinds of events and whether they are judged.
KINDS = (("click", "act", True), ("error", "fault", True), ("purchase", "act", True), ("view", "look", False))


@query(
    """with k(event_type, kind, judged) as (values ('click', 'act', true), ('error', 'fault', true), ('purchase', 'act', true), ('view', 'look', false))
select coalesce(kind, 'unknown') as kind, coalesce(judged, false) as judged, cast(count(*) as bigint) as n from events left join k using (event_type) group by all"""
)
def kind_tagging(spark, d):
    """Kinds by a small fixed table; what it does not list is unknown and not judged."""
    k = F.broadcast(spark.createDataFrame(KINDS, "event_type string, kind string, judged boolean"))
    j = table(spark, d, "events").join(k, "event_type", "left")
    return j.groupBy(F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("judged", F.lit(False)).alias("judged")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with a as (select distinct l_orderkey as f, l_partkey as k, l_linenumber as n from lineitem),
s as (select distinct l_orderkey as f, l_partkey as k, l_linenumber as n from lineitem where l_shipdate >= timestamp '1996-01-01')
select f, cast(count(*) as bigint) as orphans from a where not exists (select 1 from s where s.f = a.f and s.k = a.k and s.n = a.n) group by f"""
)
def orphan_units(spark, d):
    """Units without a symbol of the same file, key and number: an anti-join on three keys."""
    li = table(spark, d, "lineitem")
    keys = [F.col("l_orderkey").alias("f"), F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("n")]
    a = li.select(*keys).distinct()
    s = li.where(F.col("l_shipdate") >= F.expr("timestamp '1996-01-01'")).select(*keys).distinct()
    return a.join(s, ["f", "k", "n"], "left_anti").groupBy("f").agg(F.count(F.lit(1)).alias("orphans"))


@query(
    """with hop as (select s_suppkey as site, s_nationkey as nation from supplier),
one as (select n_nationkey as nation, n_regionkey as region from nation)
select site, r_name as target, cast(2 as int) as hops from hop join one using (nation) join region on r_regionkey = region"""
)
def re_export_hop(spark, d):
    """A name bound through one further hop."""
    hop = table(spark, d, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("nation"))
    one = table(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("r_regionkey"))
    return hop.join(one, "nation").join(table(spark, d, "region"), "r_regionkey").select("site", F.col("r_name").alias("target"), F.lit(2).alias("hops"))


@query(
    """with l as (select distinct l_suppkey as dir, case when l_quantity > 45 then 0 when l_discount > 0.09 then 1 when l_tax > 0.07 then 2 end as axis from lineitem)
select dir, array_to_string(list_sort(list(axis)), ',') as axes from l where axis is not null group by dir"""
)
def axes_by_directory(spark, d):
    """Which axes each directory is named on, in order."""
    axis = F.when(F.col("l_quantity") > 45, 0).when(F.col("l_discount") > 0.09, 1).when(F.col("l_tax") > 0.07, 2)
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("dir"), axis.alias("axis")).where("axis is not null")
    return l.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set("axis")).cast("array<string>"), ",").alias("axes"))


@query(
    """with s as (select p_brand as file, p_type as key, p_partkey as unit, p_size from part),
c as (select l_partkey as unit, count(*) as n from lineitem group by 1)
select file, key, cast(count(*) as bigint) as units, cast(sum(coalesce(n, 0)) as bigint) as churn, max(p_size) as largest from s left join c using (unit) group by all"""
)
def unit_signals(spark, d):
    """Signals joined by file and key at the unit's tier; what has no churn counts as zero."""
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("unit")).agg(F.count(F.lit(1)).alias("n"))
    s = table(spark, d, "part").select(F.col("p_brand").alias("file"), F.col("p_type").alias("key"), F.col("p_partkey").alias("unit"), "p_size")
    return s.join(c, "unit", "left").groupBy("file", "key").agg(
        F.count(F.lit(1)).alias("units"), F.sum(F.coalesce("n", F.lit(0))).alias("churn"), F.max("p_size").alias("largest")
    )
