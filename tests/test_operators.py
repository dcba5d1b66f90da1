"""Operators against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import edits, fingerprints, graph, intervals, similarity


def test_scripts_are_shortest():
    rng = random.Random(3)
    for n in range(500):
        a = [rng.randrange(1 + n % 4) for _ in range(rng.randrange(12))]
        b = [rng.randrange(1 + n % 4) for _ in range(rng.randrange(12))]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
            if i and j:
                best[i][j] = best[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(best[i - 1][j], best[i][j - 1])
        removed, added = edits.script(np.array(a, np.int64), np.array(b, np.int64))
        assert [x for i, x in enumerate(a) if i not in set(removed.tolist())] == [x for i, x in enumerate(b) if i not in set(added.tolist())]
        assert len(removed) + len(added) == len(a) + len(b) - 2 * best[-1][-1]


def test_scripts_have_no_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 10**9, 4000), rng.integers(0, 10**9, 4000)
    b[100:3000:50] = a[150:3050:50]
    removed, added = edits.script(a, b)
    assert len(removed) == len(added) == 4000 - 58
    same = rng.integers(0, 5, 30_000)
    assert [len(x) for x in edits.script(same, np.delete(same, 9_000))] == [1, 0]


def test_four_classes_of_lines(spark):
    old = "head\n  one thing\ntwo things\n}\nkept\n\nlast"
    new = "head\n}\nkept\n\nlast\none thing  \nnew thing\n}"
    assert edits.four_classes(old.split("\n"), new.split("\n")) == (2, 1, 1, 1)
    rows = [(1, old, new), (2, None, None), (3, "", "a"), (4, "a\na", "a")]
    got = edits.line_diff(spark.createDataFrame(rows, "i int, x string, y string"), ["i"], "x", "y").collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, 1, 1, 5), (2, 0, 0, 0, 0, 1), (3, 1, 0, 1, 0, 0), (4, 0, 0, 1, 0, 1)]


def trees(n):
    """All ordered trees of n nodes with labels a and b, as nested tuples."""
    if n == 0:
        return []
    out = []
    for kids in forests(n - 1):
        out += [("a", kids), ("b", kids)]
    return out


def forests(n):
    if n == 0:
        return [()]
    return [(t, *rest) for k in range(1, n + 1) for t in trees(k) for rest in forests(n - k)]


def post(tree):
    labels, leaves = [], []

    def walk(t):
        first = None
        for c in t[1]:
            leaf = walk(c)
            first = leaf if first is None else first
        labels.append(t[0])
        leaves.append(len(labels) - 1 if first is None else first)
        return leaves[-1]

    walk(tree)
    return labels, leaves


def forest_distance(a, b):
    """The recursive definition on forests of nested tuples."""
    memo = {}

    def d(x, y):
        if (x, y) not in memo:
            if not x and not y:
                memo[x, y] = 0
            elif not x:
                memo[x, y] = d(x, y[:-1] + y[-1][1]) + 1
            elif not y:
                memo[x, y] = d(x[:-1] + x[-1][1], y) + 1
            else:
                memo[x, y] = min(
                    d(x[:-1] + x[-1][1], y) + 1,
                    d(x, y[:-1] + y[-1][1]) + 1,
                    d(x[:-1], y[:-1]) + d(x[-1][1], y[-1][1]) + (x[-1][0] != y[-1][0]),
                )
        return memo[x, y]

    return d((a,), (b,))


def test_tree_distance_on_all_small_trees():
    every = [t for n in (1, 2, 3) for t in trees(n)]
    for a, b in itertools.product(every, every):
        assert edits.tree_distance(post(a), post(b)) == forest_distance(a, b)


def closure(nodes, arcs):
    reach = {n: {n} for n in nodes}
    while True:
        before = sum(map(len, reach.values()))
        for a, b in arcs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
        if sum(map(len, reach.values())) == before:
            return reach


@pytest.mark.parametrize("seed", range(4))
def test_graphs(spark, seed):
    rng = random.Random(seed)
    arcs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(14)})
    edges = spark.createDataFrame([*arcs, *arcs[:2]], "src bigint, dst bigint")
    real = [(a, b) for a, b in arcs if a != b]
    nodes = {n for a in real for n in a}
    reach = closure(nodes, real)
    both = closure(nodes, real + [(b, a) for a, b in real])
    assert dict(graph.components(edges).collect()) == {n: min(both[n]) for n in nodes}
    assert dict(graph.strong_components(edges).collect()) == {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    start = min(nodes)
    got = graph.reachable(edges, spark.createDataFrame([(start,)], "node bigint"))
    assert {r.node for r in got.collect()} == reach[start]


def test_graphs_of_nothing(spark):
    none = spark.createDataFrame([], "src bigint, dst bigint")
    assert graph.components(none).count() == graph.strong_components(none).count() == 0


def test_as_of_and_innermost(spark):
    rng = random.Random(5)
    left = [(rng.randrange(3), rng.randrange(20), i) for i in range(40)]
    right = [(rng.randrange(3), rng.randrange(20), float(i)) for i in range(25)]
    got = intervals.as_of(
        spark.createDataFrame(left, "k int, t int, i int"), spark.createDataFrame(right, "k int, t int, v double"), ["k"], "t", "v", ["i"]
    )
    for r in got.collect():
        have = [(t, v) for k, t, v in right if k == r.k and t <= r.t]
        assert r.v == (max(have)[1] if have else None)
    spans = [(rng.randrange(3), i, a, a + rng.randrange(9)) for i, a in enumerate(rng.choices(range(20), k=15))]
    points = sorted({(k, t) for k, t, _ in left})
    got = intervals.innermost(spark.createDataFrame(points, "g int, at int"), spark.createDataFrame(spans, "g int, span int, start int, stop int"), "g", "at").where("span is not null")
    want = {}
    for g, at in points:
        hold = [(b - a, a, s) for h, s, a, b in spans if h == g and a <= at <= b]
        if hold:
            want[g, at] = min(hold)[2]
    assert {(r.g, r.at): r.span for r in got.collect()} == want


def test_band_pairs(spark):
    rng = random.Random(8)
    rows = [("x", i, rng.randrange(1, 60)) for i in range(60)]
    got = intervals.band_pairs(spark.createDataFrame(rows, "g string, k int, n int"), "g", "k", "n", 85, 100)
    want = {
        (a, b) for (_, a, m), (_, b, n) in itertools.permutations(rows, 2) if m * 100 >= n * 85 and (m < n or (m == n and a < b))
    }
    assert {(r.a, r.b) for r in got.collect()} == want


def test_winnow(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(d, " ".join(rng.choice("abcd") for _ in range(n))) for d, n in enumerate((0, 1, 4, 7, 30, 60))]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    want = set()
    for doc, text in docs:
        words = text.split()
        h = [hashlib.md5(" ".join(words[p : p + 3]).encode()).hexdigest()[:12] for p in range(max(0, len(words) - 2))]
        for s in range(max(1, len(h) - 5 + 1) if h else 0):
            w = [(h[p], -p) for p in range(s, min(s + 5, len(h)))]
            want.add((doc, -min(w)[1], min(w)[0]))
    assert {tuple(r) for r in fingerprints.winnow(frame, 3, 5).collect()} == want
    monkeypatch.setattr(fingerprints, "_PLACES", 8)  # the way of long documents
    assert {tuple(r) for r in fingerprints.winnow(frame.where("doc_id = 5"), 3, 5).collect()} == {x for x in want if x[0] == 5}


def test_gram_hashes(spark):
    from sparkloom.functions import text as tx

    words = "a b c a b c d a b".split()
    frame = spark.createDataFrame([(words,)], "w array<string>")
    for k in (1, 2, 3, 5, 7, 9, 10):
        got = frame.select(tx.gram_hashes(F.col("w"), k)).first()[0]
        want = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
        assert len(got) == len(want) and len(set(got)) == len(set(want))
        assert len(set(zip(got, want))) == len(set(want))


def test_similarity_join_misses_no_pair(spark):
    rng = random.Random(4)
    base = [[rng.randrange(60) for _ in range(30)] for _ in range(4)]
    sets = []
    for d in range(40):
        s = set(base[d % 4])
        for _ in range(rng.randrange(5)):
            s.discard(rng.choice(sorted(s)))
            s.add(rng.randrange(60))
        sets.append((d, sorted(s), len(s)))
    frame = spark.createDataFrame(sets, "doc int, s array<bigint>, n bigint")
    got = similarity.similarity_join(frame, similarity.known(frame))
    want = {
        (a, b) for (a, x, _), (b, y, _) in itertools.combinations(sets, 2) if len({*x} & {*y}) * 100 >= 80 * len({*x} | {*y})
    }
    assert {(r.a, r.b) for r in got.collect()} == want and want


def test_segments_of_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d e f")], "doc_id int, text string")
    assert similarity.shingle_sets(docs, 1).select("doc", "n").orderBy("doc").collect() == [(3, 2)]
    assert similarity.shingle_sets(docs.where("false")).count() == 0
    assert fingerprints.grams(docs, 3).agg(F.count(F.lit(1))).first()[0] == 4


def test_graph_queries_take_every_arc(spark, sf):
    from sparkloom.plans import registry

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").collect()
    full = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]
    orders = {}
    for r in lines:
        orders.setdefault(r.l_orderkey, []).append(r)
    arcs = set()
    for rows in orders.values():
        rows.sort(key=lambda r: [r[c] for c in full])
        arcs |= {(a.l_partkey, b.l_partkey) for a, b in zip(rows, rows[1:]) if a.l_partkey != b.l_partkey}
    nodes = {n for a in arcs for n in a}
    reach = closure(nodes, arcs)
    both = closure(nodes, arcs | {(b, a) for a, b in arcs})
    run = lambda name: registry.QUERIES[f"graph_{name}"](spark, sf).collect()
    strong = {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}
    size = {c: sum(s == c for s in strong.values()) for c in strong.values()}
    assert dict(run("components")) == {n: min(both[n]) for n in nodes}
    assert dict(run("strong_components")) == strong
    assert dict(run("cycles")) == {c: n for c, n in size.items() if n >= 2}
    degrees = {n: (sum(b == n for _, b in arcs), sum(a == n for a, _ in arcs), strong[n], size[strong[n]]) for n in nodes}
    assert {r.node: (r.indeg, r.outdeg, r.component, r["size"]) for r in run("positions")} == degrees
    seeds = spark.createDataFrame([(min(nodes),)], "node bigint")
    come, front = {min(nodes)}, [min(nodes)]
    while front:
        front = [b for a, b in arcs if a in front and b not in come]
        come |= set(front)
    table = spark.createDataFrame(sorted(arcs), "src bigint, dst bigint")
    assert {r.node for r in graph.positions(table, seeds).where("reached = 1").collect()} == come


def test_relocations_cross_supplier_groups(spark, tmp_path):
    from datetime import datetime

    from sparkloom.plans import registry

    rows = [(1, 3, datetime(1997, 1, 1)), (1, 3, datetime(1997, 2, 1)), (1, 4, datetime(1998, 1, 1)), (1, 13, datetime(1998, 1, 1))]
    spark.createDataFrame(rows, "l_partkey bigint, l_suppkey bigint, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in registry.QUERIES["relocations"](spark, str(tmp_path)).collect()}
    assert got == {(3, 4, 1, 1), (3, 13, 1, 1)}


@pytest.mark.parametrize("name", ["stream_stream_join", "stream_warn_once"])
def test_streams_do_not_depend_on_the_order_of_files(spark, tmp_path, name):
    from datetime import datetime, timedelta

    from oracle import compare

    from sparkloom.plans import registry

    start = datetime(2020, 1, 1)
    rows = []
    for i in range(60):
        t = start + timedelta(days=30 * (59 - i) // 2)  # newest first, over two years
        rows += [[(3 * i, i % 7, "click", t, 1.0)], [(3 * i + 1, i % 7, "purchase", t + timedelta(minutes=20), 1.0)], [(3 * i + 2, i, "error", t, 1.0)]]
    for part in range(4):  # files of their own, dealt by remainder
        some = [r for n, x in enumerate(rows) if (n * 7 + n // 15) % 4 == part for r in x]
        schema = "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double"
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    compare(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path))


def test_large_pages_are_judged(spark):
    every = [t for n in (1, 2, 3) for t in trees(n)]
    for a, b in itertools.product(every, every):
        assert edits.tree_distance(post(a), post(b), 1) == forest_distance(a, b)
    row = "<tr>" + "<td><b>x</b></td>" * 3 + "</tr>"
    page = "<html><body><table>" + row * 42 + "</table></body></html>"  # 297 elements, and a root
    other = page.replace("<b>x</b>", "<i>x</i>", 2).replace("</table>", "<tr></tr></table>")
    pages = [(1, "http://h/a", page), (2, "http://h/b", page), (3, "http://h/c", other)]
    made = edits.page_trees(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    got = edits.page_clones(made).collect()
    assert [tuple(r) for r in got] == [(1, 3, 298, 299, 2, 1, 3, True)]
    assert [(r.page, r.copies) for r in edits.page_classes(made).orderBy("page").collect()] == [(1, 2), (3, 1)]
    assert edits.tree_distance(edits.post_order(page), edits.post_order(other)) == 3


def test_pages_are_read_in_one_pass():
    """Trees by hand: unclosed and crossed elements, quoted angles, raw elements, comments, self-closed ones, a thousand open elements."""
    for html, want in [
        ("", (["#"], [0])),
        ("<p>a<br>b", (["br", "p", "#"], [0, 0, 0])),
        ("<b><i></b></i><u/>", (["i", "b", "u", "#"], [0, 0, 2, 0])),
        ("<DIV title='a > <p>'><!-- <p> --><!doctype x></div >", (["div", "#"], [0, 0])),
        ("<script>if (a<b) '<p>'</script><p>", (["script", "p", "#"], [0, 1, 0])),
        ("<script><p>", (["script", "#"], [0, 0])),
        ("a < b <!-- <p>", (["#"], [0])),
        ("<a href=x/>y</a><a title=don't>z", (["a", "a", "#"], [0, 1, 0])),
    ]:
        assert edits.post_order(html) == want, html
    labels, leaves = edits.post_order("<q>" * 1000 + "</x>" * 1000)
    assert len(labels) == 1001 and set(leaves) == {0}


def test_lower_bounds_of_tree_distances():
    """Binary branches change by five at most with an edit, and label sequences in both orders by no more than the trees do."""
    from collections import Counter

    every = [t for n in (1, 2, 3, 4) for t in trees(n)]
    rng = random.Random(4)
    pairs = [(post(a), post(b)) for a, b in (rng.sample(every, 2) for _ in range(400))]
    for last in (True, False):
        order = (lambda t: t[0]) if last else (lambda t: edits.before_order(*t))
        least = edits.sequence_distances([(order(a), order(b)) for a, b in pairs], 40)
        for (a, b), low in zip(pairs, least):
            assert low <= edits.tree_distance(a, b)
    for a, b in pairs:
        ca, cb = Counter(edits.branches(*a)), Counter(edits.branches(*b))
        assert (ca - cb).total() + (cb - ca).total() <= 5 * edits.tree_distance(a, b)
    for above in (edits.TopDown(), edits.TopDown(most=20), edits.TopDown(deepest=1)):
        cost = [above(a, b) for a, b in pairs]
        exact = [edits.tree_distance(a, b) for a, b in pairs]
        assert all(c >= d for c, d in zip(cost, exact)) and any(c > d for c, d in zip(cost, exact))
        assert all((c == 0) == (a == b) for c, (a, b) in zip(cost, pairs))
    chain = (["p"] * 3000, [0] * 3000)  # deeper than Python's stack
    assert edits.TopDown()(chain, (["p"] * 2999 + ["q"], [0] * 3000)) >= 1
    words = ["", "a", "abc", "kitten", "sitting", "b" * 50]
    plain = {(x, y): d for x, y, d in (("kitten", "sitting", 3), ("", "abc", 3), ("abc", "a", 2), ("a", "b" * 50, 50))}
    got = edits.sequence_distances([(list(x), list(y)) for x in words for y in words])
    table = dict(zip(itertools.product(words, words), got.tolist()))
    assert all(table[k] == v for k, v in plain.items()) and all(table[x, x] == 0 for x in words)
    assert edits.sequence_distances([]).tolist() == []


def test_page_clones_are_those_of_all_pairs(spark, tmp_path):
    """Expanded by its classes, the result has the clones of every pair of pages of a host, judged one by one."""
    from sparkloom import knobs
    from sparkloom.plans import registry

    rng = random.Random(11)
    rows = []
    for i in range(48):
        n_p, n_b = rng.choice([(30, 2), (31, 2), (33, 5), (36, 2), (24, 8)])
        tags = ["p"] * n_p + ["b"] * n_b
        if rng.random() < 0.5:
            rng.shuffle(tags)
        rows.append((i, rng.choice(["http://h/x", "http://g/y", "http://h/z"]), "<html>" + "".join(f"<{t}>w</{t}>" for t in tags) + "</html>"))
    rows += [(100 + i, u, h) for i, (_, u, h) in enumerate(rows[:9])] + [(200, "http://h/n", None), (201, None, rows[0][2]), (202, "http://h/e", "")]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    num, den = knobs.TREE_RATIO
    near, far = knobs.SIZE_RATIO
    tree = {i: edits.post_order(h or "") for i, _, h in rows}
    host = {i: u and u.split("/")[2] for i, u, _ in rows}
    want = set()
    for a, b in itertools.combinations(sorted(tree), 2):
        na, nb = len(tree[a][0]), len(tree[b][0])
        if host[a] and host[a] == host[b] and min(na, nb) >= knobs.MIN_NODES and min(na, nb) * far >= max(na, nb) * near:
            d = edits.tree_distance(tree[a], tree[b])
            if (max(na, nb) - d) * den >= max(na, nb) * num:
                want.add((a, b, d))
    members = {}
    for r in registry.QUERIES["page_tree_classes"](spark, str(tmp_path)).collect():
        members.setdefault(r["class"], []).append(r.page)
    assert sorted(x for m in members.values() for x in m) == sorted(tree)
    found = registry.QUERIES["page_tree_distance"](spark, str(tmp_path)).collect()
    assert any(r.distance is None for r in found) and all(r.copies_a == len(members[r.a]) for r in found)
    got = {(min(x, y), max(x, y), r.distance) for r in found if r.clone for x in members[r.a] for y in members[r.b]}
    big = lambda m: host[m[0]] and len(tree[m[0]][0]) >= knobs.MIN_NODES
    got |= {(*pair, 0) for m in members.values() if big(m) for pair in itertools.combinations(sorted(m), 2)}
    assert got == want and len({d for *_, d in want}) > 2


def test_whole_clone_runs_pass_common_passages(spark, tmp_path):
    from sparkloom.plans import registry

    say = lambda kind, n: " ".join(f"{kind}{i}" for i in range(n))
    common = say("c", 40)
    pair = f"{say('left', 40)} {common} {say('right', 40)}"
    rows = [(1, pair), (100, pair), *((i, f"{common} {say(f'o{i}x', 5)}") for i in range(2, 72))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["clone_blocks_whole"](spark, str(tmp_path)).collect()]
    assert got == [(1, 100, 0, 0, 120, 96)]
    assert [(r.members, r.tokens) for r in registry.QUERIES["clone_groups_whole"](spark, str(tmp_path)).collect()] == [(2, 120)]
    seeded = registry.QUERIES["clone_blocks"](spark, str(tmp_path)).collect()
    assert [tuple(r)[:5] for r in seeded] == [(1, 100, 0, 0, 120)]


def test_whole_moved_blocks_pass_common_lines(spark, tmp_path):
    from sparkloom.plans import registry

    pair = "a line of the left side only\na common line in all documents\na line of the right side only"
    rows = [(1, pair), (100, pair), *((i, f"a common line in all documents\nown {i}") for i in range(2, 72))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["moved_blocks_whole"](spark, str(tmp_path)).where("a = 1 and b = 100").collect()]
    assert got == [(1, 100, 0, 0, 3, 25, True)]


def test_stretches_of_spans_are_not_broadcast(spark, sf):
    """One row of `orders` gives many stretches, so their join is no broadcast however small the table."""
    from sparkloom.plans import registry

    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 10 << 20
    plan = registry.QUERIES["interval_owner"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    sized = registry.QUERIES["interval_owner"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "loom_x" in plan and not [x for x in sized.splitlines() if "BroadcastHashJoin" in x and "loom_x" in x]


def test_band_pairs_of_near_sizes(spark):
    from sparkloom.operators import intervals

    rng = random.Random(4)
    rows = [(rng.choice("xy"), i, rng.choice([0, 1, 2, 10, 11, 12, 84, 85, 99, 100, 101, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k bigint, s bigint")
    got = intervals.band_pairs(df, "g", "k", "s", 85, 100)
    big = [(g, k, s) for g, k, s in rows if s]
    want = {(g, k, k2) for g, k, s in big for h, k2, z in big if g == h and (s, k) < (z, k2) and s * 100 >= z * 85}
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_band_join_is_dealt_over_tasks(spark, sf):
    """One file of parts gives all its pairs in more than one task."""
    from sparkloom.plans import registry

    assert registry.QUERIES["band_join"](spark, sf).rdd.getNumPartitions() > 1


def test_shingles_of_the_same_documents_fold(spark):
    """Copies of a long set give one row a document; what pairs share stays the same."""
    from sparkloom.operators import similarity

    rng = random.Random(6)
    base = [list(range(100 * i, 100 * i + 90)) for i in range(3)]
    docs = [(i, sorted({*base[i % 3], *(1000 + rng.randrange(40) for _ in range(8))})) for i in range(30)]
    sets = spark.createDataFrame(docs, "doc bigint, s array<bigint>").selectExpr("doc", "s", "cast(size(s) as bigint) as n")
    plain = similarity.known(sets)
    shared = similarity.folded(plain)
    assert shared.where("h < 1000").count() == 30 and shared.agg({"w": "sum"}).first()[0] == plain.count()
    rows = lambda x: sorted(tuple(r) for r in similarity.judged(similarity.seed_pairs(x, 9).select("a", "b"), sets, x).collect())
    assert rows(shared) == rows(plain) and rows(plain)


def test_divergence_of_many_documents(spark, tmp_path):
    """Products of four counts are beyond 64 bits here."""
    from oracle import compare

    from sparkloom.plans import registry

    docs = spark.range(120_000).selectExpr("id as doc_id", "if(id < 100000, 'web', 'book') as source", "if(id % 3 = 0, 'en', 'de') as lang")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    compare(registry.QUERIES["divergence_chi2"](spark, str(tmp_path)), registry.ORACLES["divergence_chi2"], f"{tmp_path}")


def test_settings_are_checked():
    from sparkloom import knobs

    assert knobs.checked({"soft": 100})["soft"] == 100 and knobs.checked({})["hard"] == knobs.HARD
    for bad in ({"sofft": 1}, {"soft": 900}, {"hot_cap": 0}, {"depth": 1.5}, {"near_miss": 50}):
        with pytest.raises(ValueError):
            knobs.checked(bad)


def test_deep_pages_have_a_tree():
    labels, leaves = edits.post_order("<div>" * 3000 + "x")
    assert len(labels) >= 3000 and set(leaves) == {0}


def _feed_of(spark, path, batches, schema):
    """One file for each batch, taken in their order."""
    import os
    import time

    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            at = os.path.join(path, name)
            if name.endswith(".parquet") and os.path.getmtime(at) > time.time() - 1000:
                os.utime(at, (time.time() - 2000 + 10 * n,) * 2)


def test_refresh_takes_changes_and_replays(spark, tmp_path):
    import os

    from sparkloom.streaming import feeds

    first = [(i, f"t{i}", "en") for i in range(40)]
    changed = [(3, "new", "fr"), (50, "more", "en")]
    _feed_of(spark, f"{tmp_path}/documents.parquet", [first, changed], "doc_id bigint, text string, lang string")
    want = {i: (t, s) for i, t, s in first} | {3: ("new", "fr"), 50: ("more", "en")}

    def run(folder):
        out = feeds.refreshed(feeds.stream_of(spark, folder, "documents"), "refresh", "doc_id", "text", 4)
        files = {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(out._loom_path) for f in fs if f.endswith(".parquet")}
        return {r.doc_id: (r.text, r.lang) for r in out.collect()}, len(files), out.count(), max(files.values()), files

    rows, _, n, _, _ = run(str(tmp_path))
    assert rows == want and n == len(want)
    # the same content again, in the same batches and once more: nothing is written
    written = []
    real = feeds.stores.overwrite_partitions
    feeds.stores.overwrite_partitions = lambda *a: (written.append(1), real(*a))
    try:
        _feed_of(spark, f"{tmp_path}/again/documents.parquet", [first, changed, changed, first[5:9]], "doc_id bigint, text string, lang string")
        assert run(f"{tmp_path}/again")[0] == want and len(written) == 2
    finally:
        feeds.stores.overwrite_partitions = real


def test_streams_read_their_own_table_alone(spark, tmp_path):
    from datetime import datetime

    from sparkloom.streaming import feeds

    rows = [(i, datetime(2024, 1, 1)) for i in range(5)]
    for name in ("events.parquet", "events.parquet_old", "events.parquets"):
        spark.createDataFrame(rows, "event_id int, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/dir/{name}")
    assert feeds.run_to_end(feeds.stream_of(spark, f"{tmp_path}/dir", "events"), "own").count() == 5
    one = next((tmp_path / "dir" / "events.parquet").glob("*.parquet"))
    (tmp_path / "file").mkdir()
    for name in ("events.parquet", "events.parquet_old"):
        (tmp_path / "file" / name).write_bytes(one.read_bytes())
    assert feeds.run_to_end(feeds.stream_of(spark, f"{tmp_path}/file", "events"), "own").count() == 5


def test_warnings_repeat_after_quiet_time_and_state_stays_small(spark, tmp_path):
    from datetime import datetime, timedelta

    from sparkloom.streaming import feeds, state

    start, hour = datetime(2024, 1, 1), timedelta(hours=1)
    # every batch is a day with keys of its own, and one key that always comes
    batches = [[(f"k{d}-{i}", start + 24 * d * hour + i * hour / 10) for i in range(30)] + [("always", start + 24 * d * hour + h * hour) for h in range(24)] for d in range(6)]
    batches[5].append(("late", start))
    batches[5] += [(None, start + 130 * hour), ("always", None)]
    _feed_of(spark, f"{tmp_path}/events.parquet", batches, "user string, ts timestamp_ntz")
    warned = state.warn_again(feeds.stream_of(spark, str(tmp_path), "events"), ["user"], "ts", 6 * 3_600_000, "1 hour")
    rows, tally = state.run_tallied(warned, "warn")
    got = [(r.user, r.ts) for r in rows.collect()]
    want = []
    last = {}
    for user, ts in (r for b in batches for r in b):
        if user and ts and user != "late" and (user not in last or ts >= last[user] + 6 * hour):
            last[user] = ts
            want.append((user, ts))
    assert sorted(got) == sorted(want) and len([1 for u, _ in got if u == "always"]) == 24
    assert tally.late() == 1
    # 181 keys came by; a batch has 31, and those of the days before are forgotten
    assert 0 < tally.most_state() < 31 * 2 * 4


def test_skips_are_counted_by_reason(spark, tmp_path):
    from sparkloom.streaming import feeds, state

    rows = [[(i, None if i % 5 == 0 else i, f"x{i}") for i in range(a, a + 10)] for a in (0, 10, 20)]
    _feed_of(spark, f"{tmp_path}/events.parquet", rows, "event_id int, user_id int, props string")
    reasons = {"no user": F.col("user_id").isNull(), "odd": F.col("event_id") % 2 == 1}
    kept, counts = state.skips(feeds.stream_of(spark, str(tmp_path), "events"), "skips", reasons)
    assert {r.reason: r.n for r in counts.collect()} == {"no user": 6, "odd": 12, "kept": 12}
    assert kept.columns == ["event_id", "user_id", "props"] and kept.count() == 12


def test_audit_convicts_blocks_with_a_touched_side(spark, tmp_path):
    from sparkloom.streaming import feeds, state

    blocks = spark.createDataFrame([(1, 2, 60), (1, 3, 70), (4, 5, 80), (6, 7, 90)], "a bigint, b bigint, tokens int")
    _feed_of(spark, f"{tmp_path}/documents.parquet", [[(1,), (1,)], [(3,), (None,)], [(9,)], [(7,)]], "doc_id bigint")
    got = {tuple(r) for r in state.audited(feeds.stream_of(spark, str(tmp_path), "documents"), blocks, "doc_id", "audit").collect()}
    assert got == {(1, 2, 60, True, False), (1, 3, 70, True, True), (6, 7, 90, False, True)}


@pytest.mark.parametrize("name", ["stream_tumbling", "stream_sliding", "stream_sessions"])
def test_windows_span_files_in_any_order(spark, tmp_path, name):
    from datetime import datetime, timedelta

    from oracle import compare

    from sparkloom.plans import registry

    rng = random.Random(5)
    rows = [(i, i % 3, rng.choice(["click", "error"]), datetime(1999, 1, 1) + timedelta(minutes=rng.randrange(3000)), i / 4) for i in range(200)]
    _feed_of(spark, f"{tmp_path}/events.parquet", [rows[i::4] for i in range(4)], "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz, value double")
    compare(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], str(tmp_path))


def test_versions_keep_both_writers(spark, tmp_path):
    from sparkloom.sources import stores

    path = f"{tmp_path}/store"
    one, two = stores.Versions(spark, path), stores.Versions(spark, path)
    assert one.get() is None and one.put(spark.range(1)) == 1
    two._last = lambda: None  # the second writer looked before the first one's pointer was there
    assert two.put(spark.range(2)) == 1
    assert stores.Versions(spark, path).get().count() in (1, 2)
    assert one.put(spark.range(5)) == 2 and one.get().count() == 5
    assert spark.read.parquet(f"{path}/pointers/*").count() == 3


def test_recent_window_reaches_the_scan(spark, sf, tmp_path):
    from sparkloom.plans import registry

    plan = registry.QUERIES["recent_window"](spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "NestedLoop" not in plan
    spark.createDataFrame([], "event_type string, ts timestamp_ntz, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert registry.QUERIES["recent_window"](spark, str(tmp_path)).count() == 0


def _runs_by_definition(docs, k, within=False):
    """Maximal equal runs of k words or more between two texts, or of one text with itself."""
    out = set()
    names = sorted(docs)
    for x, y in [(n, n) for n in names] if within else itertools.combinations(names, 2):
        a, b = docs[x], docs[y]
        for gap in range(1 if within else -len(a), len(b)):
            p = max(0, -gap)
            while p < len(a) and p + gap < len(b):
                n = 0
                while p + n < len(a) and p + n + gap < len(b) and a[p + n] == b[p + n + gap]:
                    n += 1
                if n >= k:
                    out.add((x, y, p, p + gap, min(n, gap) if within else n))
                p += n + 1

    def inside(r, s):
        return s[:2] == r[:2] and s[4] > r[4] and all(s[i] <= r[i] and s[i] + s[4] >= r[i] + r[4] for i in (2, 3))

    return {r for r in out if not any(inside(r, s) for s in out)}


def test_anchored_runs_are_all_long_runs(spark):
    rng = random.Random(7)
    pieces = [[f"w{rng.randrange(12)}" for _ in range(rng.randrange(3, 40))] for _ in range(12)]
    docs = {i: [w for _ in range(6) for w in rng.choice(pieces)] for i in range(14)}
    docs[20] = docs[3]
    docs[21] = ["same"] * 40
    docs[22] = ["other", *["same"] * 30]
    k, w = 6, 5
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()] + [(98, None), (99, "")], "doc_id bigint, text string")
    stream = graph.settle(fingerprints.streams(rows, k, w))
    for within in (False, True):
        got = fingerprints.anchored_runs(stream, k, 10**6, within).collect()
        want = _runs_by_definition(docs, k, within)
        sure = k + w - 1  # shorter runs are found where an anchor falls into them
        assert {tuple(r)[:5] for r in got if r.tokens >= sure} == {r for r in want if r[4] >= sure}
        assert all(docs[r.a][r.pa : r.pa + r.tokens] == docs[r.b][r.pb : r.pb + r.tokens] and r.tokens >= k for r in got)
        assert all(r.n_distinct == len(set(docs[r.a][r.pa : r.pa + r.tokens])) for r in got)


def test_hot_anchors_are_chained_and_counted(spark):
    words = [f"c{i}" for i in range(60)]
    rows = spark.createDataFrame([(i, " ".join([f"own{i}x{j}" for j in range(4)] + words)) for i in range(90)], "doc_id bigint, text string")
    stream = graph.settle(fingerprints.streams(rows, 25, 26))
    hot = similarity.hot_groups(fingerprints.anchors(stream), "g")
    runs = [tuple(r)[:5] for r in fingerprints.anchored_runs(stream, 25, hot=hot).collect()]
    assert hot.count() >= 1 and sorted(runs) == [(i, i + 1, 4, 4, 60) for i in range(89)]


def test_stretches_make_up_their_span(spark):
    rng = random.Random(4)
    spans = [(a, a + rng.choice([0, 1, 2, 3, 7, 100, 5000])) for a in (rng.randrange(-3000, 3000) for _ in range(300))] + [(0, 10**15), (5, 4), (-(10**17), 10**17)]
    rows = spark.createDataFrame(spans, "start bigint, stop bigint").withColumn("n", intervals.stretches(F.col("start"), F.col("stop"))).collect()
    for r in rows:
        if r.stop < r.start:
            assert r.n is None
            continue
        nodes = sorted((x.x << intervals.BITS * x.l, (x.x + 1 << intervals.BITS * x.l) - 1) for x in r.n)
        assert nodes[0][0] == r.start and nodes[-1][1] == r.stop and all(a[1] + 1 == b[0] for a, b in itertools.pairwise(nodes))
        assert len(nodes) <= 6 * (1 + (r.stop - r.start + 1).bit_length() // 2)


def test_innermost_of_units_and_top_level(spark):
    rng = random.Random(9)
    spans = [(g, 100 * g + i, a, a + rng.choice([0, 3, 20, 400, 100_000])) for g in range(3) for i, a in enumerate(rng.randrange(500) for _ in range(25))]
    units = [(rng.randrange(4), a, a + rng.randrange(8)) for a in (rng.randrange(-20, 700) for _ in range(300))]
    units += units[:5] + [(None, 1, 2), (1, None, 2), (1, 5, None)]
    got = intervals.innermost(
        spark.createDataFrame(units, "g int, at int, to int"), spark.createDataFrame(spans, "g int, span int, start int, stop int"), "g", "at", "to"
    ).collect()

    def owner(g, a, b):
        if None in (g, a, b):
            return None
        held = [(e - s, s, n) for h, n, s, e in spans if h == g and s <= a and b <= e]
        return min(held)[2] if held else None

    assert sorted(map(str, ((*u, owner(*u)) for u in units))) == sorted(str(tuple(r)) for r in got)


def test_medians_and_soft_lines_are_exact(spark):
    from fractions import Fraction
    from statistics import median

    from sparkloom.operators import selection

    rng = random.Random(8)
    rows = [(k, rng.choice([rng.randrange(1, 9), rng.randrange(1, 5000)])) for k in range(12) for _ in range(rng.randrange(1, 40))]
    rows += [(50, 7), (51, 3), (51, 3), (52, None), (53, -4), (54, 2), (54, 9)]
    df = spark.createDataFrame(rows, "k int, v bigint")
    group = {}
    for k, v in rows:
        if v is not None:
            group.setdefault(k, []).append(Fraction(v))
    assert {r.k: Fraction(r.top, r.bottom) for r in selection.medians(df, "k", "v").collect()} == {k: median(v) for k, v in group.items()}
    for exponent in (0, 1, 2):
        want = {}
        for k, values in group.items():
            some = [v for v in values if v > 0]
            if some:
                m = median(some)
                want[k] = min(9000, max(2, int(m * median([max(v / m, m / v) for v in some]) ** exponent)))
        assert {r.k: r.soft for r in selection.soft_lines(df, "k", "v", exponent, 2, 9000).collect()} == want


def _strong_by_definition(arcs):
    nodes = {x for a in arcs for x in a}
    ahead = {n: {b for a, b in arcs if a == n} for n in nodes}
    reach = {}
    for n in nodes:
        seen, front = set(), [n]
        while front:
            front = [y for x in front for y in ahead[x] if y not in seen]
            seen |= set(front)
            front = list(set(front))
        reach[n] = seen
    return {n: min([n, *(m for m in reach[n] if n in reach[m])]) for n in nodes}


def test_chains_and_rings_are_contracted(spark):
    rng = random.Random(6)
    for n in range(4):
        arcs = {(rng.randrange(6), rng.randrange(6)) for _ in range(7)}
        fresh = itertools.count(100)

        def chain(a, b, length):
            way = [a, *(next(fresh) for _ in range(length)), b]
            arcs.update(itertools.pairwise(way))

        for _ in range(4):
            chain(rng.randrange(6), rng.randrange(6), rng.randrange(1, 7))
        first = next(fresh)
        chain(first, first, 5 + n)  # a ring apart
        chain(50 + n, rng.randrange(6), 3)
        want = _strong_by_definition({(a, b) for a, b in arcs if a != b})
        got = graph.strong_components(spark.createDataFrame(sorted(arcs), "src bigint, dst bigint"))
        assert {r.node: r.component for r in got.collect()} == want


def test_long_paths_and_rings_take_few_rounds(spark, monkeypatch):
    n, writes = 20_000, []
    real = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: (writes.append(1), real(df))[1])
    path = spark.range(n).selectExpr("id as src", "id + 1 as dst")
    ring = spark.range(n // 2).selectExpr(f"{2 * n} + id as src", f"{2 * n} + (id + 1) % {n // 2} as dst")
    got = graph.strong_components(path.union(ring)).groupBy("component").count()
    assert {(r.component, r["count"]) for r in got.where("count > 1").collect()} == {(2 * n, n // 2)}
    assert len(writes) < 40


def test_a_stored_index_is_refreshed_and_probed(spark, tmp_path, monkeypatch):
    from sparkloom.sources import index, stores

    rng = random.Random(2)
    say = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    docs = {i: say(60) for i in range(30)}
    docs[4] = docs[3][:40] + say(10)
    frame = lambda some: spark.createDataFrame([(i, " ".join(t)) for i, t in some.items()], "doc_id bigint, text string")
    ix = index.PrintIndex(spark, str(tmp_path / "ix"), 4, 3, 8)
    assert ix.probe(frame(docs), "doc_id").count() == 0
    assert ix.put(frame(docs)) == 30
    writes = []
    real = stores.overwrite_partitions
    monkeypatch.setattr(index.stores, "overwrite_partitions", lambda *a: (writes.append(1), real(*a))[1])
    assert ix.put(frame(docs)) == 0 and not writes
    docs[7], docs[40] = say(50), docs[9][10:40]
    assert ix.put(frame({i: docs[i] for i in (3, 7, 40)})) == 2
    ix.drop(spark.createDataFrame([(5,), (999,)], "doc_id bigint"))
    gone = docs.pop(5)
    assert {r.doc for r in ix.documents().collect()} == set(docs)
    probes = {**{i: docs[i] for i in (3, 4, 40)}, 77: gone}
    got = ix.probe(frame(probes), "doc_id", itself=True).where("tokens >= 6").collect()
    want = set()
    for x, a in probes.items():
        for y, b in docs.items():
            if x != y:
                want |= {(x, y, *r[2:]) for r in _runs_by_definition({1: a, 2: b}, 6)}
    assert {tuple(r)[:5] for r in got} == want and any(r[4] >= 30 for r in want)
    plan = ix.scan(spark.createDataFrame([(docs and 12345,)], "g bigint"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
