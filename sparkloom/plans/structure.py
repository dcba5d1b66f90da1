"""Queries over the path tree of pages: rollups, owners, containment, staleness, axes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import exact
from sparkloom.plans.registry import query
from sparkloom.sources.tables import table

_HOST = r"^[a-z]+://([^/?#]+)"
_PATH = r"^[a-z]+://([^?#]+)"
_PAGES = f"""pg as (select page_id, regexp_extract(url, '{_HOST}', 1) as host, string_split(regexp_extract(url, '{_PATH}', 1), '/') as seg from pages),
up as (select page_id, host, array_to_string(seg[1 : i], '/') as dir, i as depth, len(seg) as parts from pg, unnest(range(1, len(seg))) as t(i))"""


def _pages(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", _HOST, 1).alias("host"), F.split(F.regexp_extract("url", _PATH, 1), "/", -1).alias("seg"))


def _dirs(spark, d):
    """Every page under each of its directories."""
    up = _pages(spark, d).where(F.size("seg") > 1).select("page_id", "host", "seg", F.explode(F.sequence(F.lit(1), F.size("seg") - 1)).alias("depth"))
    return up.select("page_id", "host", F.array_join(F.slice("seg", F.lit(1), F.col("depth")), "/").alias("dir"), "depth", F.size("seg").alias("parts"))


@query(
    f"""with {_PAGES} select dir, cast(min(depth) as int) as depth, cast(count(*) as bigint) as files_below,
    cast(count(*) filter (parts = depth + 1) as bigint) as files, cast(count(distinct case when parts > depth + 1 then page_id end) as bigint) as deeper from up group by dir"""
)
def directory_rollup(spark, d):
    """Files in and below each directory."""
    return _dirs(spark, d).groupBy("dir").agg(
        F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("files_below"),
        F.count_if(F.col("parts") == F.col("depth") + 1).alias("files"),
        F.countDistinct(F.when(F.col("parts") > F.col("depth") + 1, F.col("page_id"))).alias("deeper"),
    )


@query(
    f"""with {_PAGES}, k as (select dir, count(*) as files from up where parts = depth + 1 group by dir),
s as (select dir as child, regexp_replace(dir, '/[^/]*$', '') as dir from (select distinct dir from up) where contains(dir, '/')),
f as (select dir, count(*) as subdirs from s group by dir)
select coalesce(k.dir, f.dir) as dir, cast(coalesce(files, 0) as bigint) as files, cast(coalesce(subdirs, 0) as bigint) as subdirs,
    coalesce(files, 0) + coalesce(subdirs, 0) > {knobs.FANOUT} as wide from k full join f on k.dir = f.dir"""
)
def directory_fanout(spark, d):
    """Files and subdirectories of each directory, and whether they are too many."""
    dirs = _dirs(spark, d)
    k = dirs.where("parts = depth + 1").groupBy("dir").agg(F.count(F.lit(1)).alias("files"))
    s = dirs.select("dir").distinct().where(F.contains("dir", F.lit("/"))).select(F.regexp_replace("dir", "/[^/]*$", "").alias("dir"))
    f = s.groupBy("dir").agg(F.count(F.lit(1)).alias("subdirs"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return k.join(f, "dir", "full").select(
        "dir", zero("files").alias("files"), zero("subdirs").alias("subdirs"), (zero("files") + zero("subdirs") > knobs.FANOUT).alias("wide")
    )


@query(
    f"""with {_PAGES}, own as (select dir, 1 + (page_n % 3) as owner from (select dir, min(page_id) as page_n from up group by dir) where page_n % 2 = 0),
r as (select page_id, owner, row_number() over (partition by page_id order by depth desc) as n from up join own using (dir))
select page_id, cast(owner as bigint) as owner from r where n = 1"""
)
def deepest_owner(spark, d):
    """The deepest declared ancestor of each page: an equi-join on its ancestors, the deepest kept."""
    up = _dirs(spark, d)
    own = up.groupBy("dir").agg(F.min("page_id").alias("n")).where("n % 2 = 0").select("dir", (1 + F.col("n") % 3).alias("owner"))
    r = up.join(own, "dir").groupBy("page_id").agg(F.max_by("owner", "depth").alias("owner"))
    return r


@query(
    f"""with {_PAGES}, b as (select host as package, count(*) as files from pg group by host)
select package, page_id from pg join b on host = package where files >= 2"""
)
def containment_arcs(spark, d):
    """Arcs from a host to every page under it, for hosts of two pages or more."""
    pg = _pages(spark, d).select("page_id", F.col("host").alias("package"))
    many = pg.groupBy("package").count().where("count >= 2").select("package")
    return pg.join(many, "package").select("package", "page_id")


@query(
    """with t as (select l_partkey as p, max(l_shipdate) as target from lineitem group by 1),
d as (select l_suppkey as s, max(l_shipdate) as doc from lineitem where l_returnflag = 'A' group by 1)
select s, cast(count(*) as bigint) as refs, cast(count(*) filter (target > doc) as bigint) as newer, bool_or(target > doc) as stale
from (select distinct l_suppkey as s, l_partkey as p from lineitem) join t using (p) join d using (s) group by s"""
)
def staleness(spark, d):
    """A supplier is stale when something it refers to changed after it did."""
    li = table(spark, d, "lineitem")
    t = li.groupBy(F.col("l_partkey").alias("p")).agg(F.max("l_shipdate").alias("target"))
    x = li.where("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("s")).agg(F.max("l_shipdate").alias("doc"))
    refs = li.select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct().join(t, "p").join(x, "s")
    newer = F.col("target") > F.col("doc")
    return refs.groupBy("s").agg(F.count(F.lit(1)).alias("refs"), F.count_if(newer).alias("newer"), F.bool_or(newer).alias("stale"))


_EDGES = """e as (select distinct l_suppkey as a, l_partkey as b from lineitem),
ends as (select a as n, a // 10 = b // 10 as inside from e union all select b, a // 10 = b // 10 from e where a <> b)"""


@query(f"with {_EDGES} select n, cast(count(*) filter (inside) as bigint) as inner_refs, cast(count(*) filter (not inside) as bigint) as outer_refs from ends group by n")
def edge_rollup(spark, d):
    """References of all lines inside and across groups of ten, counted at both ends; no line is left out and no key is folded."""
    e = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    inside = F.floor(F.col("a") / 10) == F.floor(F.col("b") / 10)
    ends = e.select(F.col("a").alias("n"), inside.alias("inside")).unionByName(e.where("a <> b").select(F.col("b").alias("n"), inside.alias("inside")))
    return ends.groupBy("n").agg(F.count_if("inside").alias("inner_refs"), F.count_if(~F.col("inside")).alias("outer_refs"))


@query(
    f"""with {_PAGES}, k as (select dir, min(depth) as depth, count(*) filter (parts = depth + 1) as files from up group by dir),
ax as (select 0 as axis, count(*) filter (depth > 2) as v, count(*) as n from k union all select 1, count(*) filter (files > {knobs.BIG_DIR}), count(*) from k
    union all select 2, count(*) filter (files = 1), count(*) from k)
select axis, cast(v as bigint) as v, cast(n as bigint) as n, cast(case when v + n > 0 then (1000 * v) // (v + n) else 0 end as bigint) as charge from ax"""
)
def structure_axes(spark, d):
    """Deep, big and lone directories as charged axes."""
    k = _dirs(spark, d).groupBy("dir").agg(F.min("depth").alias("depth"), F.count_if(F.col("parts") == F.col("depth") + 1).alias("files"))
    n = k.agg(
        F.count_if(F.col("depth") > 2).alias("a0"), F.count_if(F.col("files") > knobs.BIG_DIR).alias("a1"), F.count_if(F.col("files") == 1).alias("a2"), F.count(F.lit(1)).alias("n")
    )
    rows = n.select("n", F.posexplode(F.array("a0", "a1", "a2")).alias("axis", "v"))
    return rows.select("axis", "v", "n", exact.charge(knobs.SCALE, F.col("v"), F.col("n")).alias("charge"))


@query(
    """select page_id, len(string_split(html, 'href="')) - 1 as links, cast(contains(html, '<h1') as int) + 2 * cast(contains(html, '<table') as int) + 4 * cast(contains(html, '<pre') as int) as marks from pages"""
)
def page_marks(spark, d):
    """Links of a page and the kinds of content it holds, as bits."""
    h = F.coalesce("html", F.lit(""))
    bits = F.contains(h, F.lit("<h1")).cast("int") + 2 * F.contains(h, F.lit("<table")).cast("int") + 4 * F.contains(h, F.lit("<pre")).cast("int")
    return table(spark, d, "pages").select("page_id", (F.size(F.split(h, 'href="', -1)) - 1).cast("bigint").alias("links"), bits.alias("marks"))


@query(
    f"""with {_PAGES}, l as (select page_id, dir, depth, row_number() over (partition by page_id order by depth desc) as n from up),
x as (select page_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) as href from pages), pg2 as (select page_id, host from pg)
select x.page_id, cast(count(*) as bigint) as refs, cast(count(*) filter (exists (select 1 from pg p where p.host || href = array_to_string(p.seg, '/') and p.host = g.host)) as bigint) as resolved
from x join pg2 g using (page_id) group by x.page_id"""
)
def page_references(spark, d):
    """Root-relative links of each page, and how many name a page of its host."""
    pg = _pages(spark, d)
    x = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("href"))
    there = pg.select(F.array_join("seg", "/").alias("target")).distinct().withColumn("hit", F.lit(1))
    asked = x.join(pg.select("page_id", "host"), "page_id").withColumn("target", F.concat("host", "href"))
    return asked.join(there, "target", "left").groupBy("page_id").agg(F.count(F.lit(1)).alias("refs"), F.count("hit").alias("resolved"))


@query(
    """with u as (select l_orderkey as f, l_linenumber as pos, l_partkey as unit, l_quantity as w from lineitem),
g as (select f, pos, sum(w) as w from u group by all),
s as (select f, pos, sum(w) over (partition by f order by pos) as above, sum(w) over (partition by f) as total, lead(pos) over (partition by f order by pos) as nxt from g),
c as (select f, pos, cast(least(above, total - above) as bigint) as benefit, cast(total as bigint) as cost from s where nxt is not null),
r as (select *, row_number() over (partition by f order by cast(benefit as decimal(38,12)) / cost desc, pos desc) as n from c)
select f, pos, benefit, cost from r where n = 1"""
)
def split_seams(spark, d):
    """The seam of each order that splits it best: balance over size, the last among equals."""
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("f"), F.col("l_linenumber").alias("pos")).agg(F.sum("l_quantity").alias("w"))
    w = Window.partitionBy("f").orderBy("pos")
    s = g.select("f", "pos", F.sum("w").over(w).alias("above"), F.sum("w").over(Window.partitionBy("f")).alias("total"), F.lead("pos").over(w).alias("nxt"))
    c = s.where("nxt is not null").select("f", "pos", F.least("above", F.col("total") - F.col("above")).cast("bigint").alias("benefit"), F.col("total").cast("bigint").alias("cost"))
    ratio = F.col("benefit").cast("decimal(20,0)") / F.col("cost").cast("decimal(10,0)")
    n = F.row_number().over(Window.partitionBy("f").orderBy(ratio.desc(), F.desc("pos")))
    return c.withColumn("n", n).where("n = 1").drop("n")
