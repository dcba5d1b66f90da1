"""Queries over documents: words, shingles, duplicates, fingerprints, clone runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom import knobs
from sparkloom.functions import text as tx
from sparkloom.operators import fingerprints as fp
from sparkloom.operators import graph, similarity, wholeruns
from sparkloom.plans.registry import query
from sparkloom.sources import stores
from sparkloom.sources.index import PrintIndex
from sparkloom.sources.tables import dealt, table

_W = r"coalesce(regexp_extract_all(lower(text), '([\p{L}\p{N}\p{M}]+)', 1), [])"
SEG = f"""seg as (select doc_id as doc, {_W} as w from documents),
sets as (
    select doc, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s
    from seg where len(w) >= {knobs.MIN_WORDS}),
cls as (select doc, s, min(doc) over (partition by list_sort(s)) as rep from sets),
reps as (select doc, s, len(s) as n from cls where doc = rep),
keys as (select doc, n, unnest(s) as h from reps)"""


def _reps(spark, d):
    """Representatives' sets and their shared shingles, each written once, as they are read from several sides."""
    sets = graph.settle(similarity.shingle_sets(dealt(spark, d, "documents")))
    reps = graph.settle(sets.join(similarity.classes(sets).where("doc = rep").select("doc"), "doc", "left_semi"))
    stores.drop(sets)
    return reps, graph.settle(similarity.known(reps))


@query(
    f"""with {SEG},
pairs as (select a.doc as a, b.doc as b, count(*) as shared, any_value(a.n) + any_value(b.n) - count(*) as united
    from keys a join keys b on a.h = b.h and a.doc < b.doc group by all)
select a, b, cast(shared as bigint) as shared, cast(united as bigint) as united from pairs where shared * 100 >= united * 80"""
)
def docdup_exact_jaccard(spark, d):
    """Near-duplicate pairs between classes of equal shingle sets, by a prefix-filtered exact join."""
    return similarity.similarity_join(*_reps(spark, d))


@query(f"with {SEG} select doc, rep from cls")
def docdup_classes(spark, d):
    """Membership: the representative of each document's class of equal shingle sets."""
    return similarity.classes(graph.settle(similarity.shingle_sets(dealt(spark, d, "documents"))))


@query(
    f"""with {SEG},
r as (select *, row_number() over (partition by h order by doc) as rn, count(*) over (partition by h) as g from keys),
pairs as (select distinct a.doc as a, b.doc as b from r a join r b
    on a.h = b.h and a.rn < b.rn and (a.g <= {knobs.HOT_CAP} or b.rn = a.rn + 1)),
j as (select a, b, len(list_intersect(x.s, y.s)) as shared, x.n + y.n as total from pairs join reps x on a = x.doc join reps y on b = y.doc)
select a, b, cast(shared as bigint) as shared, cast(total - shared as bigint) as united, shared * 100 >= (total - shared) * 80 as duplicate from j"""
)
def docdup_seed_candidates(spark, d):
    """Candidates that share a shingle, groups over the cap chained, each judged."""
    sets, known = _reps(spark, d)
    shared = graph.settle(similarity.folded(known))
    stores.drop(known)
    return similarity.judged(similarity.seed_pairs(shared).select("a", "b"), sets, shared)


@query(
    f"""with {SEG},
pairs as (select a.doc as a, b.doc as b, count(*) as shared, any_value(a.n) + any_value(b.n) - count(*) as united
    from keys a join keys b on a.h = b.h and a.doc < b.doc group by all),
dup as (select a, b from pairs where shared * 100 >= united * 80),
pl as (select doc, i as p, array_to_string(w[i : i + 4], ' ') as h from seg, unnest(range(1, len(w) - 3)) as t(i)
    where doc in (select a from dup union select b from dup)),
hits as (select a, b, x.p as pa, y.p - x.p as lane from dup join pl x on a = x.doc join pl y on b = y.doc and x.h = y.h),
isl as (select a, b, lane, pa - row_number() over (partition by a, b, lane order by pa) as i from hits),
runs as (select a, b, count(*) as n from isl group by a, b, lane, i)
select a, b, cast(max(n) + 4 as bigint) as run from runs group by a, b"""
)
def docdup_longest_run(spark, d):
    """Longest common run of words of each near-duplicate pair."""
    docs = table(spark, d, "documents")
    return similarity.longest_runs(similarity.similarity_join(*_reps(spark, d)), docs)


@query()
def docdup_lsh_recall(spark, d):
    """MinHash bands against the exact join: how many duplicate pairs the bands find."""
    sets, shared = _reps(spark, d)
    exact = similarity.similarity_join(sets, shared).select("a", "b")
    found = exact.join(similarity.lsh_pairs(sets).withColumn("hit", F.lit(1)), ["a", "b"], "left")
    return found.agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))


@query(
    f"""with {SEG}, k as (select source, count(*) as documents, count(*) filter (len(w) >= {knobs.MIN_WORDS}) as segments,
    sum(len(w)) as words from seg join documents on doc = doc_id group by rollup (source))
select source, cast(documents as bigint) as documents, cast(segments as bigint) as segments, cast(words as bigint) as words from k"""
)
def docdup_summary(spark, d):
    """Counters by source, and over all."""
    docs = table(spark, d, "documents").withColumn("n", F.size(tx.words(F.col("text"))).cast("bigint"))
    return docs.rollup("source").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("n") >= knobs.MIN_WORDS).alias("segments"),
        F.sum("n").alias("words"),
    )


@query(
    f"""with {SEG},
b as (select item_id as item, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s
    from (select item_id, {_W} as w from benchmark)),
x as (select item, len(s) as asked, unnest(s) as h from b),
y as (select doc, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) as h from seg)
select item, doc, cast(count(*) as bigint) as shared, cast(max(asked) as bigint) as asked from x join y using (h) group by item, doc"""
)
def probe_benchmark(spark, d):
    """Probe join: shingles of each benchmark item in each document."""
    return similarity.probe(dealt(spark, d, "documents"), table(spark, d, "benchmark"))


_PROBE_K, _PROBE_W = 8, 5
_PROBE_RUN = _PROBE_K + _PROBE_W - 1


@query(
    f"""with x as (select item_id as a, {_W} as w from benchmark where item_id is not null), y as (select doc_id as b, {_W} as w from documents where doc_id is not null),
gx as (select a, i as p, array_to_string(w[i : i + {_PROBE_RUN - 1}], ' ') as g from x, unnest(range(1, len(w) - {_PROBE_RUN - 2})) as t(i)),
gy as (select b, i as p, array_to_string(w[i : i + {_PROBE_RUN - 1}], ' ') as g from y, unnest(range(1, len(w) - {_PROBE_RUN - 2})) as t(i)),
hit as (select a, b, gx.p as pa, gy.p - gx.p as lane from gx join gy using (g)),
isl as (select *, pa - row_number() over (partition by a, b, lane order by pa) as i from hit),
runs as (select a, b, min(pa) - 1 as pa, min(pa) - 1 + lane as pb, count(*) + {_PROBE_RUN - 1} as tokens from isl group by a, b, lane, i)
select r.a, r.b, cast(pa as bigint) as pa, cast(pb as bigint) as pb, cast(tokens as bigint) as tokens, cast(len(list_distinct(w[pa + 1 : pa + tokens])) as bigint) as n_distinct
from runs r join x on x.a = r.a where not exists (select 1 from runs s where s.a = r.a and s.b = r.b and s.tokens > r.tokens
    and s.pa <= r.pa and s.pa + s.tokens >= r.pa + r.tokens and s.pb <= r.pb and s.pb + s.tokens >= r.pb + r.tokens)"""
)
def index_probe(spark, d):
    """Benchmark items probed against a stored index of the documents' prints: only buckets of their prints are read, and matches are extended to whole runs."""
    index = PrintIndex(spark, stores.new_path(spark, "prints"), _PROBE_K, _PROBE_W)
    index.put(dealt(spark, d, "documents"))
    return index.probe(table(spark, d, "benchmark"), "item_id").where(F.col("tokens") >= _PROBE_RUN)


_G = r"""g as (
    select doc_id as doc, i - 1 as p, left(md5(array_to_string(w[i : i + {k} - 1], ' ')), 12) as h
    from (select doc_id, """ + _W + r""" as w from documents), unnest(range(1, len(w) - {k} + 2)) as t(i))"""
_GRAM, _WINDOW = 5, knobs.WINDOW


@query(
    f"""with {_G.replace('{k}', str(_GRAM))},
m as (select doc, p, max(p) over (partition by doc) as last,
    min({{'h': h, 'q': -p}}) over (partition by doc order by p rows between current row and {_WINDOW - 1} following) as m from g)
select distinct doc, cast(-m.q as bigint) as p, m.h as h from m where p <= greatest(last - {_WINDOW - 1}, 0)"""
)
def winnow_fingerprints(spark, d):
    """Robust winnowing of word grams: the rightmost least digest of each window, once."""
    return fp.winnow(dealt(spark, d, "documents"), _GRAM, _WINDOW)


_RUNS = f"""{_G.replace('{k}', str(knobs.KGRAM))},
r as (select *, row_number() over (partition by h order by doc, p) as rn, count(*) over (partition by h) as n from g),
hit as (select a.doc as a, b.doc as b, a.p as pa, b.p as pb, a.h as h from r a join r b
    on a.h = b.h and a.rn < b.rn and (a.n <= {knobs.HOT_CAP} or b.rn = a.rn + 1) and a.doc < b.doc),
isl as (select *, pb - pa as lane, pa - row_number() over (partition by a, b, pb - pa order by pa) as i from hit),
runs as (select a, b, min(pa) as pa, min(pb) as pb, count(*) + {knobs.KGRAM - 1} as tokens, count(distinct h) as n_distinct from isl group by a, b, lane, i)"""


_WHOLE_RUNS = _RUNS.replace(f"(a.n <= {knobs.HOT_CAP} or b.rn = a.rn + 1) and ", "")

_BLOCKS = f"""select a, b, cast(pa as bigint) as pa, cast(pb as bigint) as pb, cast(tokens as bigint) as tokens, cast(n_distinct as bigint) as n_distinct
from runs x where tokens >= {knobs.RUN_TOKENS} and n_distinct >= {knobs.MIN_DISTINCT} and not exists (
    select 1 from runs y where x.a = y.a and x.b = y.b and y.tokens > x.tokens and y.pa <= x.pa and y.pa + y.tokens >= x.pa + x.tokens
        and y.pb <= x.pb and y.pb + y.tokens >= x.pb + x.tokens)"""
_GROUPS = f"""blocks as ({_BLOCKS}), both_ways as (select a as src, b as dst from blocks union select b, a from blocks),
reach(x, y) as (select src, src from both_ways union select x, dst from reach join both_ways on src = y and dst > x),
label as (select y as node, min(x) as component from reach group by y),
size as (select component, count(*) as members from label group by component),
best as (select component, count(*) as blocks, max(tokens) as tokens from blocks join label on a = node group by component)
select component, cast(members as bigint) as members, cast(blocks as bigint) as blocks, tokens from size join best using (component)"""


_K, _H = knobs.KGRAM, knobs.KGRAM // 2
_SEEDED = f"""tok as (select doc_id as doc, {_W} as w from documents),
hs as (select doc, w, list_transform(w, lambda x: cast('0x' || left(md5(x), 7) as bigint)) as h from tok where len(w) >= {_K}),
g as (select doc, i - 1 as p, (h[i] * {fp.FACTORS[0]} + h[i + {_H}] * {fp.FACTORS[1]} + h[i + {_K - 1}]) % {fp.PRIME} as n, array_to_string(w[i : i + {_K - 1}], ' ') as h
    from hs, unnest(range(1, len(w) - {_K} + 2)) as t(i)),
m as (select doc, p, max(p) over (partition by doc) as last,
    min({{'h': n, 'q': -p}}) over (partition by doc order by p rows between current row and {knobs.WINDOW - 1} following) as m from g),
an as (select distinct doc, -m.q as p from m where p <= greatest(last - {knobs.WINDOW - 1}, 0)),
r as (select doc, p, h, row_number() over (partition by h order by doc, p) as rn, count(*) over (partition by h) as n from an join g using (doc, p)),
seed as (select a.doc as a, b.doc as b, a.p as pa, b.p - a.p as lane from r a join r b
    on a.h = b.h and a.rn < b.rn and (a.n <= {knobs.HOT_CAP} or b.rn = a.rn + 1) and a.doc {{side}} b.doc),
lanes as (select distinct a, b, lane from seed),
hit as (select a, b, lane, x.p as pa from lanes join g x on x.doc = a join g y on y.doc = b and y.h = x.h and y.p - x.p = lane),
isl as (select *, pa - row_number() over (partition by a, b, lane order by pa) as i from hit),
whole as (select a, b, lane, min(pa) as pa, count(*) + {_K - 1} as len from isl group by a, b, lane, i),
held as (select distinct whole.* from whole join seed using (a, b, lane) where seed.pa between whole.pa and whole.pa + len - {_K}),
runs as (select a, b, pa, pa + lane as pb, {{tokens}} as tokens, len(list_distinct(w[pa + 1 : pa + {{tokens}}])) as n_distinct from held join tok on doc = a),
best as (select * from runs x where not exists (
    select 1 from runs y where x.a = y.a and x.b = y.b and y.tokens > x.tokens and y.pa <= x.pa and y.pa + y.tokens >= x.pa + x.tokens
        and y.pb <= x.pb and y.pb + y.tokens >= x.pb + x.tokens))"""
_BETWEEN = _SEEDED.replace("{side}", "<").replace("{tokens}", "len")
_WITHIN = _SEEDED.replace("{side}", "=").replace("{tokens}", "least(len, lane)")
_PICKED = f"""select a, b, cast(pa as bigint) as pa, cast(pb as bigint) as pb, cast(tokens as bigint) as tokens, cast(n_distinct as bigint) as n_distinct
from best where tokens >= {knobs.RUN_TOKENS} and n_distinct >= {knobs.MIN_DISTINCT}"""


def _streams(spark, d):
    """Word hashes and anchors of the documents, written once."""
    return graph.settle(fp.streams(dealt(spark, d, "documents"), knobs.KGRAM, knobs.WINDOW))


def _long(runs):
    return runs.where((F.col("tokens") >= knobs.RUN_TOKENS) & (F.col("n_distinct") >= knobs.MIN_DISTINCT))


@query(f"with {_BETWEEN} {_PICKED}")
def clone_blocks(spark, d):
    """Verified runs between two documents, long and varied enough, without those inside a longer run of the same pair: anchors, extended both ways."""
    return _long(fp.anchored_runs(_streams(spark, d), knobs.KGRAM))


@query(f"with {_WITHIN} {_PICKED}")
def clone_blocks_within(spark, d):
    """Verified runs that a document has twice; the two sides stay disjoint."""
    return _long(fp.anchored_runs(_streams(spark, d), knobs.KGRAM, within=True))


@query(
    f"""with {_BETWEEN}, groups as (select h, count(*) as n from r group by h)
select cast(count(*) filter (tokens >= {knobs.RUN_TOKENS} and n_distinct >= {knobs.MIN_DISTINCT}) as bigint) as blocks,
    cast(count(*) filter (tokens >= {knobs.RUN_TOKENS} and n_distinct < {knobs.MIN_DISTINCT}) as bigint) as suppressed,
    cast(count(*) filter (tokens >= {knobs.NEAR_MISS} and tokens < {knobs.RUN_TOKENS}) as bigint) as near_misses,
    cast((select count(*) from groups where n > {knobs.HOT_CAP}) as bigint) as chained from best"""
)
def clone_near_misses(spark, d):
    """How many runs pass, lack variety, or are near misses, and how many anchors stand in so many places that they are chained."""
    stream = _streams(spark, d)
    hot = similarity.hot_groups(fp.anchors(stream), "g")
    chained = hot.agg(F.count(F.lit(1)).alias("chained"))
    return _counted(fp.anchored_runs(stream, knobs.KGRAM, hot=hot)).crossJoin(F.broadcast(chained))


def _counted(runs):
    t, v = F.col("tokens"), F.col("n_distinct")
    return runs.agg(
        F.count_if((t >= knobs.RUN_TOKENS) & (v >= knobs.MIN_DISTINCT)).alias("blocks"),
        F.count_if((t >= knobs.RUN_TOKENS) & (v < knobs.MIN_DISTINCT)).alias("suppressed"),
        F.count_if((t >= knobs.NEAR_MISS) & (t < knobs.RUN_TOKENS)).alias("near_misses"),
    )


@query(
    f"""with {_WHOLE_RUNS} select cast(count(*) filter (tokens >= {knobs.RUN_TOKENS} and n_distinct >= {knobs.MIN_DISTINCT}) as bigint) as blocks,
    cast(count(*) filter (tokens >= {knobs.RUN_TOKENS} and n_distinct < {knobs.MIN_DISTINCT}) as bigint) as suppressed,
    cast(count(*) filter (tokens >= {knobs.NEAR_MISS} and tokens < {knobs.RUN_TOKENS}) as bigint) as near_misses from runs"""
)
def clone_near_misses_whole(spark, d):
    """The same counts with all places of every gram paired."""
    return wholeruns.whole_counts(dealt(spark, d, "documents"), knobs.KGRAM, knobs.RUN_TOKENS, knobs.MIN_DISTINCT)


@query(f"with recursive {_BETWEEN}, {_GROUPS.replace(_BLOCKS, _PICKED).replace("best as", "most as").replace("join best", "join most")}")
def clone_groups(spark, d):
    """Groups of documents connected by clone blocks: members, blocks, longest run. Least labels spread in rounds."""
    return _grouped(graph.settle(clone_blocks(spark, d)))


def _grouped(blocks):
    label = graph.components(blocks.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    size = label.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    best = blocks.join(label, blocks["a"] == label["node"]).groupBy("component").agg(
        F.count(F.lit(1)).alias("blocks"), F.max("tokens").alias("tokens")
    )
    return size.join(best, "component")


@query(
    f"with {_WHOLE_RUNS} {_BLOCKS}"
)
def clone_blocks_whole(spark, d):
    """Clone blocks with all places of every gram paired: no run breaks at a common passage. Quadratic in a gram's places."""
    return wholeruns.whole_runs(dealt(spark, d, "documents"), knobs.KGRAM, knobs.RUN_TOKENS, knobs.MIN_DISTINCT)


@query(f"with recursive {_WHOLE_RUNS}, {_GROUPS}")
def clone_groups_whole(spark, d):
    """Groups of documents connected by clone blocks, with all places of every gram paired."""
    return _grouped(graph.settle(clone_blocks_whole(spark, d)))


_LINES = """ln as (select doc_id as doc, unnest(range(1, len(l) + 1)) as p, unnest(l) as line
    from (select doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)) as l from documents)),
sig as (select doc, p, line, length(regexp_replace(line, '[^\\p{L}\\p{N}]', '', 'g')) as width from ln)"""


@query(
    f"""with {_LINES} select doc, cast(count(*) as bigint) as lines, cast(count(*) filter (width > 0) as bigint) as significant,
    cast(sum(width) as bigint) as width, cast(max(width) as bigint) as widest from sig group by doc"""
)
def line_significance(spark, d):
    """Lines, those that hold a letter or digit, and their widths."""
    docs = table(spark, d, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("line"))
    w = docs.select(F.col("doc_id").alias("doc"), tx.alnum_width(F.col("line")).alias("width"))
    return w.groupBy("doc").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("width") > 0).alias("significant"), F.sum("width").alias("width"), F.max("width").alias("widest")
    )


@query(
    f"""with {_LINES}, k as (select *, sum(case when width = 0 then 1 else 0 end) over (partition by doc order by p) as i from sig)
select doc, cast(min(p) as bigint) as first_line, cast(count(*) as bigint) as n_lines, cast(sum(width) as bigint) as width
from k where width > 0 group by doc, i"""
)
def paragraph_segments(spark, d):
    """Paragraphs as islands of adjacent significant lines."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(tx.lines(F.col("text"))).alias("p", "line"))
    w = docs.withColumn("width", tx.alnum_width(F.col("line")))
    gap = F.sum(F.when(F.col("width") == 0, 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("p"))
    return (
        w.withColumn("i", gap)
        .where("width > 0")
        .groupBy("doc", "i")
        .agg((F.min("p") + 1).cast("bigint").alias("first_line"), F.count(F.lit(1)).alias("n_lines"), F.sum("width").alias("width"))
        .drop("i")
    )


# Markers of licence headers.
MARKERS = ("licensed under", "all rights reserved", "spdx-license-identifier", "released under the", "public license")
_ANY = " or ".join(f"contains(lower(coalesce(text, '')), '{m}')" for m in MARKERS)


@query(
    f"""select case when {_ANY} then 'licence' when length(coalesce(text, '')) = 0 then 'empty' else 'none' end as exempt,
    cast(count(*) as bigint) as n from documents group by 1"""
)
def exemption_classes(spark, d):
    """Documents by why they are exempt from judgement."""
    t = F.lower(F.coalesce("text", F.lit("")))
    marked = F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(t, F.lit(m))
    kind = F.when(marked, "licence").when(F.length(t) == 0, "empty").otherwise("none")
    return table(spark, d, "documents").groupBy(kind.alias("exempt")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """with w as (select lang, source, unnest(coalesce(regexp_extract_all(lower(text), '([\\p{L}\\p{N}\\p{M}]+)', 1), [])) as word from documents),
c as (select lang, word, count(*) as n from w group by all),
r as (select *, row_number() over (partition by lang order by n desc, word) as rank from c)
select lang, word, cast(n as bigint) as n, cast(rank as integer) as rank from r where rank <= 20"""
)
def top_words(spark, d):
    """The twenty commonest words of each language."""
    w = table(spark, d, "documents").select("lang", F.explode(tx.words(F.col("text"))).alias("word"))
    counts = w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return counts.withColumn("rank", rank).where("rank <= 20")


@query(
    """with t as (select conv_id, turn, string_split(coalesce(text, ''), chr(10)) as l from conversations),
p as (select a.conv_id, a.turn, a.l as x, b.l as y from t a join t b on a.conv_id = b.conv_id and b.turn = a.turn + 1)
select conv_id, turn, cast(len(list_filter(y, lambda v: not list_contains(x, v))) as bigint) as novel,
    cast(len(list_filter(x, lambda v: not list_contains(y, v))) as bigint) as deleted from p"""
)
def turn_changes(spark, d):
    """Lines that a turn has and the one before had not, and the other way about."""
    t = table(spark, d, "conversations").select("conv_id", "turn", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("l"))
    a, b = t.alias("a"), t.alias("b")
    p = a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1))
    return p.select(
        F.col("a.conv_id").alias("conv_id"),
        F.col("a.turn").alias("turn"),
        F.size(F.filter(F.col("b.l"), lambda v: ~F.array_contains(F.col("a.l"), v))).cast("bigint").alias("novel"),
        F.size(F.filter(F.col("a.l"), lambda v: ~F.array_contains(F.col("b.l"), v))).cast("bigint").alias("deleted"),
    )


@query()
def turn_line_diff(spark, d):
    """Four classes of lines between consecutive turns, from a shortest script in linear space: novel, moved, deleted, moved out, and those kept."""
    from sparkloom.operators import edits

    t = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return edits.line_diff(t.withColumn("after", after).where("after is not null"), ["conv_id", "turn"], "text", "after")


@query()
def page_tree_distance(spark, d):
    """Tree edit distance between classes of equal pages of one host whose element counts are near: size and label prunes, then Zhang-Shasha in Arrow
    batches, once for each pair of trees. `page_tree_classes` says which pages a class has."""
    from sparkloom.operators import edits

    return edits.page_clones(graph.settle(edits.page_trees(dealt(spark, d, "pages"))))


@query()
def page_tree_classes(spark, d):
    """Every page with the smallest page of its host that has the same tree of elements, and how many have it."""
    from sparkloom.operators import edits

    trees = graph.settle(edits.page_trees(dealt(spark, d, "pages")).select("page", "host", "tree", "n"))
    classes = edits.page_classes(trees).select(F.col("host").alias("its"), F.col("tree").alias("form"), F.col("page").alias("class"), "copies")
    return trees.join(classes, F.col("host").eqNullSafe(F.col("its")) & (F.col("tree") == F.col("form"))).select("page", "n", "class", "copies")
