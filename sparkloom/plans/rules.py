"""Queries for rules over pairs, arcs, layouts, changes and admission, each beside SQL written from the rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import exact
from sparkloom.functions import text as tx
from sparkloom.operators import graph, intervals, similarity
from sparkloom.operators import fingerprints as fp
from sparkloom.plans.registry import query
from sparkloom.plans.structure import _PAGES, _dirs, _pages
from sparkloom.plans.texts import _BETWEEN, _W, _reps
from sparkloom.sources import stores
from sparkloom.sources.tables import dealt, table

_ERA = "timestamp '1997-01-01'"


# ---- documents: the verdict's two arms, and prints that documents share

_RUN = knobs.VERBATIM_WORDS
_REP_RUNS = _BETWEEN.replace(f"(select doc_id as doc, {_W} as w from documents)", "(select doc, w from reps)")


@query(
    f"""with seg as (select doc_id as doc, {_W} as w from documents),
sets as (select doc, w, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s from seg where len(w) >= {knobs.MIN_WORDS}),
reps as (select doc, w, s from (select *, min(doc) over (partition by list_sort(s)) as rep from sets) where doc = rep),
keys as (select doc, len(s) as n, unnest(s) as h from reps),
alike as (select a.doc as a, b.doc as b from keys a join keys b on a.h = b.h and a.doc < b.doc group by all
    having count(*) * 100 >= (any_value(a.n) + any_value(b.n) - count(*)) * 80),
{_REP_RUNS},
verbatim as (select distinct a, b from runs where tokens >= {_RUN})
select coalesce(x.a, y.a) as a, coalesce(x.b, y.b) as b, x.a is not null as alike, y.a is not null as verbatim
from alike x full join verbatim y on x.a = y.a and x.b = y.b"""
)
def docdup_verdicts(spark, d):
    """Duplicates of either kind between representatives: similarity of 0.8 or more, or a common run of fifty words.

    Runs come from anchors, of which any fifty common words hold one. A passage in more places than the cap gives a chain of pairs that connects its documents,
    not all of them.
    """
    reps, shared = _reps(spark, d)
    alike = similarity.similarity_join(reps, shared).select("a", "b", F.lit(True).alias("alike"))
    docs = dealt(spark, d, "documents").join(reps.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi")
    runs = fp.anchored_runs(graph.settle(fp.streams(docs, knobs.KGRAM, knobs.WINDOW)), knobs.KGRAM)
    pairs = runs.where(F.col("tokens") >= _RUN).select("a", "b").distinct()
    both = alike.join(pairs.withColumn("verbatim", F.lit(True)), ["a", "b"], "full")
    return both.select("a", "b", F.coalesce("alike", F.lit(False)).alias("alike"), F.coalesce("verbatim", F.lit(False)).alias("verbatim"))


_PRINT_K, _PRINT_W, _PRINT_LEAST = 8, 16, 3


@query(
    f"""with g as (select doc_id as doc, i - 1 as p, left(md5(array_to_string(w[i : i + {_PRINT_K - 1}], ' ')), 12) as h
    from (select doc_id, {_W} as w from documents), unnest(range(1, len(w) - {_PRINT_K - 2})) as t(i)),
m as (select doc, p, max(p) over (partition by doc) as last,
    min({{'h': h, 'q': -p}}) over (partition by doc order by p rows between current row and {_PRINT_W - 1} following) as m from g),
pr as (select distinct doc, m.h as h from m where p <= greatest(last - {_PRINT_W - 1}, 0)),
r as (select *, row_number() over (partition by h order by doc) as rn, count(*) over (partition by h) as n from pr)
select a.doc as a, b.doc as b, cast(count(*) as bigint) as shared from r a join r b
on a.h = b.h and a.rn < b.rn and (a.n <= {knobs.HOT_CAP} or b.rn = a.rn + 1) group by all having count(*) >= {_PRINT_LEAST}"""
)
def print_cooccurrence(spark, d):
    """Pairs of documents by how many winnowed prints they share; prints of very many documents are chained, so that their groups stay connected."""
    prints = graph.settle(fp.winnow(dealt(spark, d, "documents"), _PRINT_K, _PRINT_W).select("doc", "h").distinct())
    pairs = similarity.capped_pairs(prints, "h", ["doc"])
    counted = pairs.groupBy(F.col("a.doc").alias("a"), F.col("b.doc").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return counted.where(F.col("shared") >= _PRINT_LEAST)


_FENCE, _COMMENT, _CODE = "(?s)```.*?```", "(?s)<!--.*?-->", "`[^`\\n]*`"


@query(
    f"""with t as (select doc_id, coalesce(text, '') as t0 from documents),
f as (select *, regexp_replace(t0, '{_FENCE}', '', 'g') as t1 from t), c as (select *, regexp_replace(t1, '{_COMMENT}', '', 'g') as t2 from f),
k as (select *, regexp_replace(t2, '{_CODE}', '', 'g') as t3 from c)
select doc_id, cast(length(t0) - length(t1) as bigint) as fenced, cast(length(t1) - length(t2) as bigint) as comments,
    cast(length(t2) - length(t3) as bigint) as code, cast(length(t3) as bigint) as visible from k"""
)
def markup_masking(spark, d):
    """Characters of each text inside fences, comments and inline code, in that order, and those that stay visible."""
    t = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t0"))
    for i, pattern in enumerate((_FENCE, _COMMENT, _CODE)):
        t = t.withColumn(f"t{i + 1}", F.regexp_replace(f"t{i}", pattern, ""))
    n = [F.length(f"t{i}").cast("bigint") for i in range(4)]
    return t.select("doc_id", (n[0] - n[1]).alias("fenced"), (n[1] - n[2]).alias("comments"), (n[2] - n[3]).alias("code"), n[3].alias("visible"))


# Lines that are no prose, in the order in which they are asked.
_LINE_KINDS = (
    ("blank", r"^\s*$"),
    ("html", r"^\s*<[/!a-zA-Z]"),
    ("heading", r"^#{1,6}\s"),
    ("table", r"^\s*\||\s\|\s"),
    ("marker", r"^\s*([-*+]|[0-9]+[.)])\s*$"),
)
_LINE_CASE = " ".join(f"when regexp_matches(line, '{p}') then '{n}'" for n, p in _LINE_KINDS)


@query(
    f"""with l as (select unnest(string_split(coalesce(text, ''), chr(10))) as line from documents)
select case {_LINE_CASE} else 'prose' end as kind, cast(count(*) as bigint) as n, cast(sum(length(line)) as bigint) as chars from l group by 1"""
)
def paragraph_lines(spark, d):
    """Lines by whether they may be part of a paragraph: markup, headings, table rows and bare list markers may not."""
    l = table(spark, d, "documents").select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    kind = F.when(F.lit(False), "")
    for name, pattern in _LINE_KINDS:
        kind = kind.when(F.col("line").rlike(pattern), name)
    return l.groupBy(kind.otherwise("prose").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).cast("bigint").alias("chars"))


# ---- pages: labels of trees, bands of structure, layouts

_TAGS = "regexp_extract_all(lower(coalesce(html, '')), '<([a-z][a-z0-9]*)', 1)"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


def _tags():
    return F.regexp_extract_all(F.lower(F.coalesce("html", F.lit(""))), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))


_NUM, _DEN = knobs.TREE_RATIO


@query(
    f"""with p as (select page_id, {_HOST} as host, {_TAGS} as g from pages), s as (select page_id, host, len(g) as n, unnest(g) as tag from p where len(g) >= {knobs.MIN_NODES}),
h as (select page_id, host, n, tag, count(*) as c from s group by all),
pairs as (select a.page_id as a, b.page_id as b, a.n as na, b.n as nb, sum(least(a.c, b.c)) as common from h a join h b
    on a.host = b.host and a.tag = b.tag and (a.n < b.n or (a.n = b.n and a.page_id < b.page_id)) and a.n * {_DEN} >= b.n * {_NUM} group by all)
select cast(count(*) as bigint) as near, cast(count(*) filter (common * {_DEN} >= nb * {_NUM}) as bigint) as kept,
    cast(count(*) filter (common * {_DEN} < nb * {_NUM}) as bigint) as pruned, cast(sum(common) as bigint) as common from pairs"""
)
def label_prune(spark, d):
    """Pairs of pages of one host and near size: common labels, counted with multiplicity, and whether these are enough for a tree comparison."""
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), _tags().alias("g"))
    p = p.withColumn("n", F.size("g").cast("bigint")).where(F.col("n") >= knobs.MIN_NODES)
    pairs = intervals.band_pairs(p, "host", "page_id", "n", _NUM, _DEN)
    h = graph.settle(p.select("page_id", "n", F.explode("g").alias("tag")).groupBy("page_id", "n", "tag").agg(F.count(F.lit(1)).alias("c")))
    # one map of labels for each page: it is as long as there are kinds of elements
    m = h.groupBy("page_id", "n").agg(F.map_from_entries(F.collect_list(F.struct("tag", "c"))).alias("m"))
    a = m.select(F.col("page_id").alias("a"), F.col("m").alias("ma"))
    b = m.select(F.col("page_id").alias("b"), F.col("m").alias("mb"), F.col("n").alias("nb"))
    least = F.aggregate(F.map_keys("ma"), F.lit(0).cast("bigint"), lambda t, k: t + F.least(F.col("ma")[k], F.coalesce(F.try_element_at("mb", k), F.lit(0))))
    both = pairs.join(a, "a").join(b, "b").select("nb", least.alias("common")).where("common > 0")
    kept = F.col("common") * _DEN >= F.col("nb") * _NUM
    return both.agg(F.count(F.lit(1)).alias("near"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("pruned"), F.sum("common").alias("common"))


_BANDS, _BAND_ROWS = 4, 2


@query(
    f"""with p as (select page_id, {_TAGS} as g from pages),
s as (select distinct page_id, array_to_string(g[i : i + 3], ' ') as h from p, unnest(range(1, len(g) - 2)) as x(i)),
m as (select page_id, r, min(md5(r || ':' || h)) as m from s, unnest(range(0, {_BANDS * _BAND_ROWS})) as t(r) group by all),
k as (select page_id, r // {_BAND_ROWS} as band, string_agg(m, ',' order by r) as key from m group by all),
g as (select band, key, count(*) as size from k group by all)
select cast(band as int) as band, cast(size as bigint) as size, cast(count(*) as bigint) as groups from g group by all"""
)
def structural_bands(spark, d):
    """MinHash bands over runs of four element kinds: how many groups of each size a band has. Minima are folded in partial aggregates."""
    k = _band_keys(spark, d)
    size = k.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"))
    return size.groupBy("band", "size").agg(F.count(F.lit(1)).alias("groups"))


_BAND_KEYS = f"""p as (select page_id, {_TAGS} as g from pages),
s as (select distinct page_id, array_to_string(g[i : i + 3], ' ') as h from p, unnest(range(1, len(g) - 2)) as x(i)),
m as (select page_id, r, min(md5(r || ':' || h)) as m from s, unnest(range(0, {_BANDS * _BAND_ROWS})) as t(r) group by all),
k as (select page_id, r // {_BAND_ROWS} as band, string_agg(m, ',' order by r) as key from m group by all)"""


def _band_keys(spark, d):
    g = table(spark, d, "pages").select("page_id", _tags().alias("g")).where(F.size("g") >= 4)
    runs = F.transform(F.sequence(F.lit(1), F.size("g") - 3), lambda i: F.array_join(F.slice("g", i, F.lit(4)), " "))
    s = g.select("page_id", F.explode(F.array_distinct(runs)).alias("h"))
    minima = [F.min(F.md5(F.concat(F.lit(f"{r}:"), "h").cast("binary"))).alias(f"m{r}") for r in range(_BANDS * _BAND_ROWS)]
    keys = F.array(*(F.concat_ws(",", *(f"m{b * _BAND_ROWS + r}" for r in range(_BAND_ROWS))) for b in range(_BANDS)))
    return s.groupBy("page_id").agg(*minima).select("page_id", F.posexplode(keys).alias("band", "key"))


@query(
    f"""with {_BAND_KEYS}, r as (select *, count(*) over (partition by band, key) as n, row_number() over (partition by band, key order by page_id) as rn from k),
c as (select a.page_id as a, b.page_id as b, a.n > {knobs.HOT_CAP} as hot from r a join r b on a.band = b.band and a.key = b.key and a.rn < b.rn and (a.n <= {knobs.HOT_CAP} or b.rn = a.rn + 1))
select a, b, cast(count(*) as bigint) as bands, bool_or(hot) as chained from c group by a, b"""
)
def structural_candidates(spark, d):
    """Pairs of pages that share a band of structure, in how many bands, and whether one of them was too crowded to be paired and was chained instead, so that all its
    pages stay connected. A group of any size takes rows in proportion to its pages."""
    keys = graph.settle(_band_keys(spark, d).select(F.concat_ws(":", "band", "key").alias("h"), "page_id"))
    pairs = similarity.capped_pairs(keys, "h", ["page_id"])
    return pairs.groupBy(F.col("a.page_id").alias("a"), F.col("b.page_id").alias("b")).agg(F.count(F.lit(1)).alias("bands"), F.bool_or("hot").alias("chained"))


# Languages and the weight each is declared to have.
LAYOUT = (("de", 2), ("en", 6), ("es", 4), ("it", 1))
_LCM, _TOTAL = 12, sum(w for _, w in LAYOUT)
_LAYOUT_SQL = ", ".join(f"('{s}', {w})" for s, w in LAYOUT)


@query(
    f"""with k(lang, w) as (values {_LAYOUT_SQL}), o as (select lang, count(*) as o from documents where lang is not null group by 1),
j as (select lang, w, coalesce(o, 0) as o from o full join k using (lang)), n as (select sum(o) as n from j where w is not null),
x as (select cast(sum(cast({_TOTAL} * o - n * w as hugeint) * ({_TOTAL} * o - n * w) * ({_LCM} // w)) filter (w is not null) as hugeint) as top, any_value(n) as n,
    count(*) filter (w is null) as unowned, count(*) filter (w is not null and o = 0) as empty from j, n)
select cast(unowned as bigint) as unowned, cast(empty as bigint) as empty, cast(case when n > 0 then 1000 * top // (cast(n as hugeint) * {_TOTAL * _LCM}) end as bigint) as divergence from x"""
)
def declared_layout(spark, d):
    """Documents by language against declared weights: languages without a declaration, declared ones without documents, and the chi-square divergence
    in thousandths: one exact fraction over a common denominator, rounded down once; none where no declared language has documents."""
    k = F.broadcast(spark.createDataFrame(LAYOUT, "lang string, w bigint"))  # a fixed table
    o = table(spark, d, "documents").where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("o"))
    j = o.join(k, "lang", "full").withColumn("o", F.coalesce("o", F.lit(0)).cast("bigint"))
    n = j.where("w is not null").agg(F.sum("o").alias("n"))
    gap = (F.lit(_TOTAL) * F.col("o") - F.col("n") * F.col("w")).cast("decimal(18,0)")
    part = (gap * gap).cast("decimal(36,0)") * (F.lit(_LCM) / F.col("w")).cast("decimal(2,0)")
    x = j.join(n, how="cross").agg(
        F.count_if(F.col("w").isNull()).alias("unowned"),
        F.count_if(F.col("w").isNotNull() & (F.col("o") == 0)).alias("empty"),
        F.sum(F.when(F.col("w").isNotNull(), part)).alias("top"),
        F.max("n").alias("n"),
    )
    value = F.expr(f"(1000 * top) div (cast(n as decimal(20,0)) * {_TOTAL * _LCM})")
    return x.select("unowned", "empty", F.when(F.col("n") > 0, value).cast("bigint").alias("divergence"))


@query(
    f"""with {_PAGES}, c as (select page_id, md5(array_to_string({_TAGS}, ' ')) as block from pages), many as (select block from c group by 1 having count(*) >= 2),
t as (select distinct block, dir from c join many using (block) join up using (page_id))
select dir, cast(count(*) as bigint) as blocks from t group by dir"""
)
def redundancy_rollup(spark, d):
    """Blocks of pages of equal structure by directory: a block counts once for every directory that holds one of its pages at any depth."""
    c = table(spark, d, "pages").select("page_id", F.md5(F.array_join(_tags(), " ").cast("binary")).alias("block"))
    many = c.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("block")
    held = c.join(many, "block").join(_dirs(spark, d).select("page_id", "dir"), "page_id").select("block", "dir").distinct()
    return held.groupBy("dir").agg(F.count(F.lit(1)).alias("blocks"))


@query(
    f"""with {_PAGES}, k as (select dir, min(page_id) as page_id, min(depth) as depth, count(*) filter (parts = depth + 1) as files from up group by dir),
s as (select dir, count(distinct child) as kids from (select u.dir, v.dir as child from up u join up v on u.page_id = v.page_id and v.depth = u.depth + 1) group by dir),
f as (select k.*, files = 0 and coalesce(kids, 0) = 1 as folds from k left join s using (dir)),
stay as (select u.page_id, u.dir, u.depth from up u join f using (dir) where not folds)
select f.dir, folds, (select min_by(stay.dir, stay.depth) from stay where stay.page_id = f.page_id and stay.depth >= f.depth) as shown_as from f"""
)
def chain_fold(spark, d):
    """Directories that hold nothing but one directory are shown as the first one below that holds more: islands over the path of any page below."""
    up = _dirs(spark, d)
    k = up.groupBy("dir").agg(F.min("page_id").alias("page_id"), F.count_if(F.col("parts") == F.col("depth") + 1).alias("files"))
    child = F.lead("dir").over(Window.partitionBy("page_id").orderBy("depth"))
    kids = up.withColumn("child", child).where("child is not null").groupBy("dir").agg(F.countDistinct("child").alias("kids"))
    f = k.join(kids, "dir", "left").withColumn("folds", (F.col("files") == 0) & (F.coalesce("kids", F.lit(0)) == 1))
    path = up.select("page_id", "dir", "depth").join(f.select("dir", "folds"), "dir")
    below = Window.partitionBy("page_id").orderBy("depth").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    end = F.first(F.when(~F.col("folds"), F.col("dir")), ignorenulls=True).over(below)
    shown = path.withColumn("shown_as", end).select("page_id", "dir", "shown_as")
    return f.select("dir", "page_id", "folds").join(shown, ["dir", "page_id"]).select("dir", "folds", "shown_as")


# ---- arcs: admission, seeds, tallies

_RUNG = 5


@query(
    f"""with r as (select l_suppkey as a, p_partkey as b, l_linenumber as rung, p_type like 'PROMO%' as asset from lineitem left join part on p_partkey = l_partkey),
k as (select case when b is null then 'unowned' when a = b then 'self' when asset then 'asset' when rung > {_RUNG} then 'weak' else 'admitted' end as fate from r)
select fate, cast(count(*) as bigint) as n from k group by fate"""
)
def arc_admission(spark, d):
    """Every reference by its fate: without an owner, to itself, to an asset, of too weak a rung, or admitted. What is dropped is counted, first reason first."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("p_partkey"), F.col("l_linenumber").alias("rung"))
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("b"), F.startswith("p_type", F.lit("PROMO")).alias("asset"))
    fate = F.when(F.col("b").isNull(), "unowned").when(F.col("a") == F.col("b"), "self").when(F.col("asset"), "asset").when(F.col("rung") > _RUNG, "weak").otherwise("admitted")
    return li.join(p, "p_partkey", "left").groupBy(fate.alias("fate")).agg(F.count(F.lit(1)).alias("n"))


_ENTRY = 126
_FLAGS = ("p_size >= 45", "p_size < 3", "p_retailprice >= 1800", "p_retailprice < 950", "p_brand like '%55'", "p_type like 'PROMO%'", "p_name like 'a%'")
_FLAG_SQL = " + ".join(f"{1 << i} * cast({c} as int)" for i, c in enumerate(_FLAGS))


@query(f"with f as (select p_partkey as node, {_FLAG_SQL} as flags from part) select node, flags from f where flags & {_ENTRY} <> 0")
def entry_seeds(spark, d):
    """Nodes that count as entries: those with a flag other than the first, by a bit mask."""
    flags = F.expr(" + ".join(f"{1 << i} * cast({c} as int)" for i, c in enumerate(_FLAGS)))
    f = table(spark, d, "part").select(F.col("p_partkey").alias("node"), flags.alias("flags"))
    return f.where(F.col("flags").bitwiseAND(_ENTRY) != 0)


_BIG_FILE = 40


@query(
    f"""with u as (select distinct l_orderkey as c, l_suppkey as f, l_partkey as unit from lineitem),
big as (select l_suppkey as f, count(*) as lines from lineitem group by 1 having count(*) > {_BIG_FILE}),
p as (select a.f, a.unit as a, b.unit as b, count(distinct a.c) as commits from u a join u b on a.c = b.c and a.f = b.f and a.unit < b.unit group by all)
select f, a, b, cast(commits as bigint) as commits, cast(least(greatest(b - a, 1), lines) as bigint) as span from p join big using (f)"""
)
def seam_pairs(spark, d):
    """Units of one oversized file that changed in one commit: pairs, how often, and their distance clamped to the file."""
    li = table(spark, d, "lineitem")
    big = li.groupBy(F.col("l_suppkey").alias("f")).agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") > _BIG_FILE)
    u = li.select(F.col("l_orderkey").alias("c"), F.col("l_suppkey").alias("f"), F.col("l_partkey").alias("unit")).distinct().join(big, "f")
    p = u.select("c", "f", "lines", F.col("unit").alias("a")).join(u.select("c", "f", F.col("unit").alias("b")), ["c", "f"]).where("a < b")
    n = p.groupBy("f", "lines", "a", "b").agg(F.countDistinct("c").alias("commits"))
    return n.select("f", "a", "b", "commits", F.least(F.greatest(F.col("b") - F.col("a"), F.lit(1)), "lines").cast("bigint").alias("span"))


# ---- changes: pairs, survival, relocated units, orders of units, erasure


@query(
    f"""with b as (select distinct l_partkey as content, l_suppkey as path from lineitem where l_shipdate < {_ERA}),
a as (select distinct l_partkey as content, l_suppkey as path from lineitem where l_shipdate >= {_ERA}),
gone as (select *, row_number() over (partition by content order by path) as k from (select * from b except select * from a)),
new as (select *, row_number() over (partition by content order by path) as k from (select * from a except select * from b))
select content, case when g.path is null then 'added' when n.path is null then 'deleted' else 'renamed' end as status, g.path as old_path, n.path as new_path
from gone g full join new n using (content, k)"""
)
def change_pairs(spark, d):
    """Paths of a content before and after: one that went and one that came are a rename, in order; a further copy is an addition."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("content"), F.col("l_suppkey").alias("path"), (F.col("l_shipdate") < F.expr(_ERA)).alias("early"))
    sides = li.groupBy("content", "path").agg(F.bool_or("early").alias("was"), F.bool_or(~F.col("early")).alias("is"))
    one = sides.where(F.col("was") != F.col("is"))
    k = F.row_number().over(Window.partitionBy("content", "was").orderBy("path"))
    ranked = one.withColumn("k", k)
    gone = ranked.where("was").select("content", "k", F.col("path").alias("old_path"))
    new = ranked.where("is").select("content", "k", F.col("path").alias("new_path"))
    j = gone.join(new, ["content", "k"], "full")
    status = F.when(F.col("old_path").isNull(), "added").when(F.col("new_path").isNull(), "deleted").otherwise("renamed")
    return j.select("content", status.alias("status"), "old_path", "new_path")


@query(
    """with h as (select max(l_shipdate) as head from lineitem)
select l_suppkey as file, cast(count(*) as bigint) as lines, cast(count(*) filter (l_shipdate >= head - interval 365 days) as bigint) as recent from lineitem, h group by 1"""
)
def dated_survival(spark, d):
    """Lines of each file, and those dated within a year of the newest of all. The newest date is one row."""
    li = table(spark, d, "lineitem")
    head = F.broadcast(li.agg(F.max("l_shipdate").alias("head")))
    recent = F.col("l_shipdate") >= F.col("head") - F.expr("interval 365 days")
    return li.join(head, how="cross").groupBy(F.col("l_suppkey").alias("file")).agg(F.count(F.lit(1)).alias("lines"), F.count_if(recent).alias("recent"))


@query(
    f"""with b as (select l_partkey as unit, l_linenumber as line, l_suppkey as at_file from lineitem where l_shipdate < {_ERA}),
a as (select l_partkey as unit, l_linenumber as line, l_suppkey as at_file from lineitem where l_shipdate >= {_ERA}),
ch as (select distinct unit, line, at_file from a where not exists (select 1 from b where b.unit = a.unit and b.line = a.line and b.at_file = a.at_file)),
m as (select ch.*, exists (select 1 from b where b.unit = ch.unit and b.line = ch.line) as moved from ch)
select unit, cast(count(*) as bigint) as changed from m group by unit having count(*) filter (moved) = count(*)"""
)
def relocated_intact(spark, d):
    """Units of which every changed line is one that stood elsewhere before: moved as they were."""
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("unit"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("at_file"), (F.col("l_shipdate") < F.expr(_ERA)).alias("early"))
    places = li.groupBy("unit", "line", "at_file").agg(F.bool_or("early").alias("was"), F.bool_or(~F.col("early")).alias("is"))
    had = F.max("was").over(Window.partitionBy("unit", "line"))
    changed = places.withColumn("moved", had).where("is and not was")
    counts = changed.groupBy("unit").agg(F.count(F.lit(1)).alias("changed"), F.count_if("moved").alias("moved"))
    return counts.where("moved = changed").select("unit", "changed")


@query(
    """with r as (select l_orderkey, l_linenumber, l_shipdate, row_number() over (partition by l_orderkey order by l_linenumber, l_shipdate) as k,
    lag(l_shipdate) over (partition by l_orderkey order by l_linenumber, l_shipdate) as prev from lineitem),
o as (select l_orderkey, bool_and(l_linenumber = k) as dense, bool_and(coalesce(l_shipdate >= prev, true)) as ascending, bool_and(coalesce(l_shipdate >= prev + interval 7 days, true)) as apart from r group by 1)
select dense, ascending, apart, cast(count(*) as bigint) as orders from o group by all"""
)
def order_checks(spark, d):
    """Orders by whether their lines are numbered densely, ascend in time, and stand a week apart."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", F.row_number().over(w).alias("k"), F.lag("l_shipdate").over(w).alias("prev"))
    o = r.groupBy("l_orderkey").agg(
        F.bool_and(F.col("l_linenumber") == F.col("k")).alias("dense"),
        F.bool_and(F.coalesce(F.col("l_shipdate") >= F.col("prev"), F.lit(True))).alias("ascending"),
        F.bool_and(F.coalesce(F.col("l_shipdate") >= F.col("prev") + F.expr("interval 7 days"), F.lit(True))).alias("apart"),
    )
    return o.groupBy("dense", "ascending", "apart").agg(F.count(F.lit(1)).alias("orders"))


@query(
    f"""with b as (select distinct o_custkey as k from orders where o_orderdate < {_ERA}), c as (select distinct o_custkey as k from orders where o_orderdate >= {_ERA})
select count(*) = 0 as shrinks, cast(count(*) as bigint) as extra, min(k) as first_extra from (select k from c except select k from b)"""
)
def baseline_subset(spark, d):
    """Whether what there is now is a subset of the baseline, how much is not, and the first of it."""
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.expr(_ERA)
    b, c = (o.where(x).select(F.col("o_custkey").alias("k")).distinct() for x in (early, ~early))
    extra = c.join(b, "k", "left_anti")
    return extra.agg((F.count(F.lit(1)) == 0).alias("shrinks"), F.count(F.lit(1)).alias("extra"), F.min("k").alias("first_extra"))


@query(
    """with t as (select l_orderkey as path, l_linenumber as span, l_quantity >= 49 as whole from lineitem where l_returnflag = 'R'),
f as (select path, bool_or(whole) as whole from t group by path)
select path, cast(null as bigint) as span, true as whole from f where whole
union all select distinct path, cast(span as bigint), false from t where path not in (select path from f where whole)"""
)
def erase_closure(spark, d):
    """Targets closed under containment: a whole file subsumes its spans, and each target stands once. The whole files come from a partial aggregate."""
    t = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("bigint").alias("span"), (F.col("l_quantity") >= 49).alias("whole"))
    whole = t.groupBy("path").agg(F.bool_or("whole").alias("whole")).where("whole").select("path")
    spans = t.join(whole, "path", "left_anti").select("path", "span").distinct()
    return whole.select("path", F.lit(None).cast("bigint").alias("span"), F.lit(True).alias("whole")).unionByName(spans.withColumn("whole", F.lit(False)))


@query(
    """with k as (select doc_id, n_chars, count(*) over (partition by md5(coalesce(text, ''))) as n, min(doc_id) over (partition by md5(coalesce(text, ''))) as keeper from documents),
r as (select *, n > 1 and doc_id <> keeper and n_chars >= 20 as gone from k)
select 'erased' as part, cast(count(*) filter (gone) as bigint) as n, cast(coalesce(sum(n_chars) filter (gone), 0) as bigint) as chars from r
union all select 'kept', cast(count(*) filter (not gone) as bigint), cast(coalesce(sum(n_chars) filter (not gone), 0) as bigint) from r"""
)
def erase_applied(spark, d):
    """The erase plan carried out: survivors are a new version of the store, and a log says what went and for which keeper. Read back from both."""
    docs = table(spark, d, "documents").withColumn("h", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    g = docs.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"))
    judged = docs.join(g, "h").withColumn("gone", (F.col("n") > 1) & (F.col("doc_id") != F.col("keeper")) & (F.col("n_chars") >= 20))
    rows = graph.settle(judged.select("doc_id", "n_chars", "keeper", "gone"))
    store, log = stores.Versions(spark, stores.new_path(spark, "erase")), stores.new_path(spark, "erase-log")
    store.put(docs.select("doc_id", "n_chars"))
    rows.where("gone").select("doc_id", "n_chars", "keeper").write.parquet(log)  # the log first: what is gone is always told
    store.put(rows.where("not gone").select("doc_id", "n_chars"))
    count = lambda df, part: df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chars"), F.lit(0)).cast("bigint").alias("chars"))
    return count(spark.read.parquet(log), "erased").unionByName(count(store.get(), "kept"))


@query(
    """select o_custkey as key, cast(count(*) as bigint) as v from orders where o_orderdate >= timestamp '1996-01-01' group by 1"""
)
def stamped_cache(spark, d):
    """A cache of values by key and stamp: what another tool version wrote stays, but only rows of the current stamp are read; a rerun replaces them."""
    o = table(spark, d, "orders").withColumn("key", F.col("o_custkey"))
    path = stores.new_path(spark, "cache")
    value = lambda rows, stamp: rows.groupBy("key").agg(F.count(F.lit(1)).alias("v")).withColumn("stamp", F.lit(stamp))
    stores.overwrite_partitions(value(o, "old"), path, "stamp")
    for _ in range(2):
        stores.overwrite_partitions(value(o.where("o_orderdate >= timestamp '1996-01-01'"), "current"), path, "stamp")
    return spark.read.parquet(path).where("stamp = 'current'").select("key", "v")


# ---- trends and soft lines, exactly


@query(
    """with d as (select cast(o_orderdate as date) as day, sum(1) as y from orders group by 1), k as (select *, row_number() over (order by day) - 1 as x from d),
s as (select count(*) as n, sum(x) as sx, sum(y) as sy, sum(x * y) as sxy, sum(x * x) as sxx from k)
select cast(n as bigint) as points, cast(n * sxy - sx * sy as bigint) as top, cast(n * sxx - sx * sx as bigint) as low,
    case when n < 3 then 'few' when 1000 * abs(n * sxy - sx * sy) <= n * sxx - sx * sx then 'flat' when n * sxy > sx * sy then 'up' else 'down' end as trend from s"""
)
def trend_verdict(spark, d):
    """Least squares of orders by day as a fraction, and its verdict: too few points, inside the dead band of a thousandth, up or down.

    Days are few beside orders: they are counted first, and their places come from a window over days alone.
    """
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("y"))
    k = days.withColumn("x", F.row_number().over(Window.orderBy("day")) - 1)
    s = k.agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"))
    top, low = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    trend = F.when(F.col("n") < knobs.MIN_POINTS, "few").when(1000 * F.abs(top) <= low, "flat").when(top > 0, "up").otherwise("down")
    return s.select(F.col("n").alias("points"), top.alias("top"), low.alias("low"), trend.alias("trend"))


@query(
    f"""with m as (select l_orderkey as f, 5 * l_linenumber as p from lineitem), r as (select *, lag(p) over (partition by f order by p) as prev from m where p <> 15),
i as (select *, sum(case when prev is null or p - prev > {knobs.BRIDGE} then 1 else 0 end) over (partition by f order by p) as k from r)
select f, cast(min(p) as bigint) as first_line, cast(max(p) as bigint) as last_line, cast(count(*) as bigint) as lines from i group by f, k"""
)
def bridged_runs(spark, d):
    """Runs of changed lines of a file; a gap of up to seven lines does not part them."""
    w = Window.partitionBy("f").orderBy("p")
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("f"), (5 * F.col("l_linenumber")).alias("p")).where("p <> 15").withColumn("prev", F.lag("p").over(w))
    k = F.sum(F.when(F.col("prev").isNull() | (F.col("p") - F.col("prev") > knobs.BRIDGE), 1).otherwise(0)).over(w)
    i = r.withColumn("k", k).groupBy("f", "k")
    return i.agg(F.min("p").cast("bigint").alias("first_line"), F.max("p").cast("bigint").alias("last_line"), F.count(F.lit(1)).alias("lines")).drop("k")


# ---- seven axes of a tree, and the score over those that are judged

_NAMING_LEAST, _NAMING_MOST, _DUP_LEAST = 2, 500, 1
_STYLE = (("[0-9]", 0), ("-", 1), ("_", 2))
_STYLE_SQL = " ".join(f"when regexp_matches(leaf, '{p}') then {c}" for p, c in _STYLE)
_SEVEN = f"""{_PAGES}, k as (select dir, min(depth) as depth, count(*) filter (parts = depth + 1) as files from up group by dir),
sub as (select regexp_replace(dir, '/[^/]*$', '') as dir, count(*) as subdirs from (select distinct dir from up) where contains(dir, '/') group by 1),
own as (select page_id, host, array_to_string(seg[1 : len(seg) - 1], '/') as dir, seg[len(seg)] as leaf from pg where len(seg) > 1),
style as (select dir, case {_STYLE_SQL} else 3 end as style, count(*) as c from own group by all),
x as (select page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="(/[^"]*)"', 1)) as href from pages),
ref as (select page_id, dir, count(*) filter (host || regexp_replace(href, '/[^/]*$', '') = dir) as inside, count(*) filter (host || regexp_replace(href, '/[^/]*$', '') <> dir) as outside
    from x join own using (page_id) group by all),
c as (select page_id, md5(array_to_string({_TAGS}, ' ')) as block from pages), many as (select block from c group by 1 having count(*) >= 2),
named as (select 0 as axis, k.dir from k left join sub using (dir) where depth > {knobs.DEPTH} or files + coalesce(subdirs, 0) > {knobs.FANOUT}
    union all select 1, dir from style group by dir having sum(c) >= {_NAMING_LEAST} and case when count(*) <= 1 then 0 else (1000 * (sum(c) * sum(c) - sum(c * c)) * count(*)) // (sum(c) * sum(c) * (count(*) - 1)) end > {_NAMING_MOST}
    union all select 2, dir from ref group by dir having sum(inside) + sum(outside) >= {knobs.MIX} and sum(outside) > sum(inside)
    union all select distinct 3, dir from ref where outside >= {knobs.MISPLACED} and outside > 2 * inside
    union all select 4, k.dir from k where files >= {knobs.BIG_DIR} and dir not in (select dir from own where leaf like 'index%')
    union all select distinct 6, dir from c join many using (block) join up using (page_id) group by dir having count(distinct block) >= {_DUP_LEAST})"""


@query(
    f"""with {_SEVEN}, n as (select count(*) as n from k), a(axis, judged) as (values (0, true), (1, true), (2, true), (3, true), (4, true), (5, false), (6, true)),
v as (select a.axis, judged, n, count(dir) as v from a left join named using (axis), n group by all),
ch as (select *, case when judged then case when v > 0 and n > 0 then ({knobs.SCALE} * v) // (v + n) else 0 end end as charge from v)
select axis, judged, cast(case when judged then v end as bigint) as v, cast(n as bigint) as n, cast(charge as bigint) as charge,
    cast(greatest(0, {knobs.SCALE} - sum(charge) over () // count(charge) over ()) as bigint) as score from ch"""
)
def structure_seven(spark, d):
    """Directories named on each axis (geometry, naming, mixing, misplacement, documentation, staleness, redundancy), their charges, and the score
    over the axes that are judged. Pages have no dates, so staleness has no facts: it is not judged, which is no zero."""
    axes, n = _named(spark, d)
    judged = spark.createDataFrame([(i, i != 5) for i in range(7)], "axis int, judged boolean")  # a fixed table
    v = axes.groupBy("axis").agg(F.count(F.lit(1)).alias("v"))
    rows = F.broadcast(judged).join(v, "axis", "left").join(n, how="cross").withColumn("v", F.when(F.col("judged"), F.coalesce("v", F.lit(0))))
    charged = rows.withColumn("charge", F.when(F.col("judged"), exact.charge(knobs.SCALE, F.col("v"), F.col("n"))))
    sums = charged.agg(F.sum("charge").alias("total"), F.count("charge").alias("many"))
    score = F.greatest(F.lit(0).cast("bigint"), knobs.SCALE - exact.whole(F.col("total"), F.col("many")))
    return charged.join(sums, how="cross").select("axis", "judged", "v", "n", "charge", score.alias("score"))


@query(f"with {_SEVEN} select dir, string_agg(cast(axis as varchar), ',' order by axis) as axes from named group by dir")
def structure_findings(spark, d):
    """The axes on which each directory is named, in order."""
    axes, _ = _named(spark, d)
    return axes.groupBy("dir").agg(F.array_join(F.array_sort(F.collect_set("axis")).cast("array<string>"), ",").alias("axes"))


def _named(spark, d):
    """(axis, dir) of all findings, and one row with the number of directories."""
    up = graph.settle(_dirs(spark, d))
    k = up.groupBy("dir").agg(F.min("depth").alias("depth"), F.count_if(F.col("parts") == F.col("depth") + 1).alias("files"))
    sub = up.select("dir").distinct().where(F.contains("dir", F.lit("/"))).groupBy(F.regexp_replace("dir", "/[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("subdirs"))
    geometry = k.join(sub, "dir", "left").where((F.col("depth") > knobs.DEPTH) | (F.col("files") + F.coalesce("subdirs", F.lit(0)) > knobs.FANOUT))

    own = _pages(spark, d).where(F.size("seg") > 1).select(
        "page_id", "host", F.array_join(F.slice("seg", F.lit(1), F.size("seg") - 1), "/").alias("dir"), F.element_at("seg", -1).alias("leaf")
    )
    style = F.when(F.lit(False), 0)
    for pattern, code in _STYLE:
        style = style.when(F.col("leaf").rlike(pattern), code)
    kinds = own.groupBy("dir", style.otherwise(3).alias("style")).agg(F.count(F.lit(1)).alias("c"))
    spread = kinds.groupBy("dir").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("s"), F.count(F.lit(1)).alias("b"))
    naming = spread.where((F.col("t") >= _NAMING_LEAST) & (exact.tsallis_permille(F.col("t"), F.col("s"), F.col("b")) > _NAMING_MOST))

    href = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="(/[^"]*)"'), F.lit(1))
    x = table(spark, d, "pages").select("page_id", F.explode(href).alias("href")).join(own, "page_id")
    here = F.concat("host", F.regexp_replace("href", "/[^/]*$", "")) == F.col("dir")
    ref = graph.settle(x.groupBy("page_id", "dir").agg(F.count_if(here).alias("inside"), F.count_if(~here).alias("outside")))
    touched = ref.groupBy("dir").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    mixing = touched.where((F.col("i") + F.col("o") >= knobs.MIX) & (F.col("o") > F.col("i")))
    misplaced = ref.where((F.col("outside") >= knobs.MISPLACED) & (F.col("outside") > 2 * F.col("inside"))).select("dir").distinct()
    undocumented = k.where(F.col("files") >= knobs.BIG_DIR).join(own.where("leaf like 'index%'").select("dir").distinct(), "dir", "left_anti")
    redundant = redundancy_rollup(spark, d).where(F.col("blocks") >= _DUP_LEAST)
    named = None
    for axis, rows in ((0, geometry), (1, naming), (2, mixing), (3, misplaced), (4, undocumented), (6, redundant)):
        one = rows.select(F.lit(axis).alias("axis"), "dir")
        named = one if named is None else named.unionByName(one)
    return named, k.agg(F.count(F.lit(1)).alias("n"))


# ---- stacking: what a turn adds against what it takes away


@query(
    f"""with t as (select conv_id, turn, list_distinct({_W}) as w from conversations),
p as (select a.conv_id, b.turn, len(list_filter(b.w, lambda v: not list_contains(a.w, v))) as novel, len(list_filter(a.w, lambda v: not list_contains(b.w, v))) as deleted
    from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, cast(novel as bigint) as novel, cast(deleted as bigint) as deleted, novel >= {knobs.STACK_LINES} and {knobs.STACK_RATIO} * deleted < novel as stacked from p"""
)
def stacking_verdict(spark, d):
    """Turns that add at least twenty words the one before had not, and more than ten for each that they drop."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.array_distinct(tx.words(F.col("text"))).alias("w"))
    p = t.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("w").alias("before")).join(t, ["conv_id", "turn"])
    novel, deleted = F.size(F.array_except("w", "before")).cast("bigint"), F.size(F.array_except("before", "w")).cast("bigint")
    return p.select("conv_id", "turn", novel.alias("novel"), deleted.alias("deleted")).withColumn(
        "stacked", (F.col("novel") >= knobs.STACK_LINES) & (F.col("deleted") * knobs.STACK_RATIO < F.col("novel"))
    )
