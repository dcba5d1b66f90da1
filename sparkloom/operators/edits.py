"""Edit distances: shortest line scripts and ordered-tree distance, in Arrow batches over rows that Spark deals out."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom import knobs
from sparkloom.operators.graph import settle
from sparkloom.operators.intervals import band_pairs

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _slide(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x after following equal lines from each (x, y): all diagonals at once, in steps that double where few are left."""
    x, y = x.copy(), y.copy()
    live = np.flatnonzero((x >= 0) & (y >= 0) & (x < len(a)) & (y < len(b)))
    while len(live):
        if len(live) <= 4:
            for i in live.tolist():
                step = 16
                while True:
                    n = min(step, len(a) - x[i], len(b) - y[i])
                    unlike = np.flatnonzero(a[x[i] : x[i] + n] != b[y[i] : y[i] + n])
                    run = int(unlike[0]) if len(unlike) else n
                    x[i], y[i], step = x[i] + run, y[i] + run, step * 2
                    if len(unlike) or not n:
                        break
            return x
        live = live[a[x[live]] == b[y[live]]]
        x[live] += 1
        y[live] += 1
        live = live[(x[live] < len(a)) & (y[live] < len(b))]
    return x


def _middle(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """Begin and end of a run of equal lines (it may be empty) in the middle of a shortest script; both sides have lines and differ at both ends.

    Furthest places are kept for the last number of edits alone, from both ends, so memory is linear.
    """
    n, m = len(a), len(b)
    gap, most = n - m, (n + m + 1) // 2
    flip_a, flip_b = a[::-1], b[::-1]
    ahead, back = np.full(2 * most + 3, -1), np.full(2 * most + 3, -1)
    ahead[most + 2] = back[most + 2] = 0
    zero = most + 1
    for d in range(most + 1):
        k = np.arange(-d, d + 1, 2)
        for far, p, q, forwards in ((ahead, a, b, True), (back, flip_a, flip_b, False)):
            down = far[zero + k + 1]
            right = far[zero + k - 1] + 1
            start = np.where((k == -d) | ((k != d) & (right - 1 < down)), down, right)
            x = _slide(p, q, start, start - k)
            x = np.where((start > n) | (start - k > m) | (start < 0), -1, x)
            far[zero + k] = x
            other = back if forwards else ahead
            # a diagonal k of one end is gap - k of the other
            twin = gap - k
            reach = d - 1 if forwards else d
            seen = (np.abs(twin) <= reach) & ((twin + reach) % 2 == 0)
            if (gap % 2 == 1) != forwards or not seen.any():
                continue
            met = np.flatnonzero(seen & (x >= 0))
            met = met[x[met] + other[zero + twin[met]] >= n]
            if len(met):
                i = met[0]
                s, e = int(start[i]), int(x[i])
                return (s, s - int(k[i]), e, e - int(k[i])) if forwards else (n - e, m - (e - int(k[i])), n - s, m - (s - int(k[i])))
    raise AssertionError("the two searches did not meet")


def script(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(removed, added): the lines of a and of b that a shortest script changes, as numbers of lines; in linear space, without a bound on edits."""
    removed, added = [], []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = a[a0:a1], b[b0:b1]
        n = min(len(x), len(y))
        unlike = np.flatnonzero(x[:n] != y[:n])
        lo = int(unlike[0]) if len(unlike) else n
        a0, b0, x, y, n = a0 + lo, b0 + lo, x[lo:], y[lo:], n - lo
        unlike = np.flatnonzero(x[len(x) - n :][::-1] != y[len(y) - n :][::-1])
        hi = int(unlike[0]) if len(unlike) else n
        x, y = x[: len(x) - hi], y[: len(y) - hi]
        if not len(x) or not len(y):
            removed.append(np.arange(a0, a0 + len(x)))
            added.append(np.arange(b0, b0 + len(y)))
            continue
        s, t, e, f = _middle(x, y)
        todo.append((a0, a0 + s, b0, b0 + t))
        todo.append((a0 + e, a0 + len(x), b0 + f, b0 + len(y)))
    none = np.zeros(0, np.int64)
    return np.sort(np.concatenate([none, *removed])), np.sort(np.concatenate([none, *added]))


def four_classes(a: list[str], b: list[str]) -> tuple[int, int, int, int]:
    """(novel, moved in, deleted, moved out) of the changed lines: a line with a letter or digit moved if the other side has its content among its changed lines."""
    code: dict[str, int] = {}
    removed, added = script(*(np.array([code.setdefault(x, len(code)) for x in side], np.int64) for side in (a, b)))
    out, come = ([side[i].strip() for i in at.tolist()] for side, at in ((a, removed), (b, added)))
    says = {x: any(map(str.isalnum, x)) for x in {*out, *come}}
    gone, here = set(out), set(come)
    moved_in, moved_out = sum(says[x] and x in gone for x in come), sum(says[x] and x in here for x in out)
    return len(come) - moved_in, moved_in, len(out) - moved_out, moved_out


def line_diff(rows: DataFrame, keep: list[str], before: str, after: str) -> DataFrame:
    """`keep`, novel, moved, deleted, moved_out, kept for two texts of a row; a null text has no lines but one that is empty."""
    names = ("novel", "moved", "deleted", "moved_out", "kept")
    schema = T.StructType([*(rows.schema[k] for k in keep), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for batch in batches:
            out = []
            for x, y in zip(batch.column(before).to_pylist(), batch.column(after).to_pylist()):
                a, b = (x or "").split("\n"), (y or "").split("\n")
                classes = four_classes(a, b)
                out.append((*classes, len(b) - classes[0] - classes[1]))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(list(c), pa.int64()) for c in cols)], names=schema.names)

    return rows.select(*keep, before, after).mapInArrow(run, schema)


# a comment, a declaration, or a tag with its slash, name and what follows it; a quoted value may hold any character
_TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+(?:"[^"]*"|'[^']*')?)*+)>""", re.S)
_UNQUOTED = re.compile(r"""=\s*[^\s"'>][^\s>]*\Z""")
#: Elements whose content is no markup, and where it ends.
_RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in ("script", "style")}


def post_order(html: str) -> tuple[list[str], list[int]]:
    """Labels of a page's elements and each one's leftmost leaf, in post order, in one pass; the last is a root that is no element.

    An end tag closes the nearest open element of its name with all that is open in it, and none if there is none. What is open at the end is closed there.
    """
    labels: list[str] = []
    leaves: list[int] = []
    stack, opened = [("#", 0)], {"#": 1}

    def close(tag):
        while True:
            top, leaf = stack.pop()
            labels.append(top)
            leaves.append(leaf)
            opened[top] -= 1
            if top == tag:
                return

    at, found = 0, _TOKEN.search(html)
    while found:
        at = found.end()
        ends, tag, rest = found.groups()
        if tag:
            tag = tag.lower()
            if ends:
                if opened.get(tag):
                    close(tag)
            elif tag in VOID:
                leaves.append(len(labels))
                labels.append(tag)
            else:
                stack.append((tag, len(labels)))
                opened[tag] = opened.get(tag, 0) + 1
                if rest.endswith("/") and not _UNQUOTED.search(rest):
                    close(tag)
                elif tag in _RAW:
                    end = _RAW[tag].search(html, at)
                    at = end.start() if end else len(html)
        found = _TOKEN.search(html, at)
    close("#")
    return labels, leaves


def _forests(first: list[int], width: int) -> list[tuple]:
    """The forests of a tree's key roots side by side, in blocks of about `width` columns: those that hold no other come first.

    A block has, for each column, how many nodes its prefix has and an offset that grows from forest to forest, and for the columns of nodes:
    place, node, place of the prefix before the node's subtree, and whether the subtree is all of the prefix.
    """
    last = {f: j for j, f in enumerate(first)}
    level: dict[int, int] = {}
    for j in sorted(last.values()):
        q = first[j]
        level[j] = max((level[last[f]] + 1 for f in first[q : j + 1] if f != q), default=0)
    blocks: list[list[int]] = []
    room = at = -1
    for j in sorted(level, key=lambda j: (level[j], j)):
        need = j - first[j] + 2
        if level[j] != at or need > room:
            blocks.append([])
            at, room = level[j], width
        blocks[-1].append(j)
        room -= need
    out, tree = [], np.array(first)
    for roots in blocks:
        sizes = np.array([j - first[j] + 2 for j in roots])
        start = np.repeat(np.cumsum(sizes) - sizes, sizes)
        count = np.arange(len(start)) - start
        q = np.repeat([first[j] for j in roots], sizes)
        place = np.flatnonzero(count)
        node = (q + count - 1)[place]
        before = tree[node] - q[place]
        apart = np.repeat(np.arange(len(roots)), sizes)
        out.append((count, apart, place, node, start[place] + before, before == 0))
    return out


def tree_distance(a: tuple[list[str], list[int]], b: tuple[list[str], list[int]], most: int = 1 << 22) -> int:
    """Least number of node inserts, deletes and relabels between two ordered trees (Zhang-Shasha).

    A row of the table is found for many key roots of the second tree at once, in blocks of about `most` cells, however large the trees;
    what comes from the left is a running minimum, which an offset starts anew at each forest.
    """
    (la, fa), (lb, fb) = a, b
    if not la or not lb:
        return len(la) + len(lb)
    code = {c: i for i, c in enumerate({*la, *lb})}
    ca, cb = (np.array([code[c] for c in x]) for x in (la, lb))
    dist = np.zeros((len(la), len(lb)), np.int64)
    blocks = [
        (count, count + apart * (len(la) + len(lb) + 2), place, node, left, whole, cb[node], place[whole], node[whole])
        for count, apart, place, node, left, whole in _forests(fb, most // (len(la) + 1))
    ]
    for i in sorted({f: i for i, f in enumerate(fa)}.values()):
        p = fa[i]
        for count, offset, place, node, left, whole, labels, at, tops in blocks:
            w = np.empty((i - p + 2, len(count)), np.int64)
            w[0] = count
            for x, s in enumerate(range(p, i + 1), 1):
                best = w[fa[s] - p][left] + dist[s][node]
                if fa[s] == p:
                    best = np.where(whole, w[x - 1][place - 1] + (labels != ca[s]), best)
                row = w[x - 1] + 1
                row[place] = np.minimum(row[place], best)
                row -= offset
                np.minimum.accumulate(row, out=w[x])
                w[x] += offset
                if fa[s] == p:
                    dist[s, tops] = w[x][at]
    return int(dist[-1, -1])


def branches(labels: list[str], leaves: list[int]) -> list[str]:
    """Each node's label with its first child's and its next sibling's, in post order; where there is none, the part is empty."""
    first, after = [""] * len(labels), [""] * len(labels)
    for i in range(len(labels)):
        child, right = i - 1, ""
        while child >= leaves[i]:
            after[child] = right
            first[i] = right = labels[child]
            child = leaves[child] - 1
    return [f"{x} {y} {z}" for x, y, z in zip(labels, first, after)]


def before_order(labels: list[str], leaves: list[int]) -> list[str]:
    """Labels with parents before their children, from post order."""
    out, work = [], [len(labels) - 1]
    while work:
        i = work.pop()
        out.append(labels[i])
        child = i - 1
        while child >= leaves[i]:
            work.append(child)
            child = leaves[child] - 1
    return out


def sequence_distances(pairs: list[tuple[list[str], list[str]]], most: int = 1 << 18) -> np.ndarray:
    """Edit distances of many pairs of label sequences: a row of all their tables at once, in groups of near lengths of about `most` cells a row."""
    out = np.zeros(len(pairs), np.int64)
    codes: dict[str, int] = {}
    rows = [tuple(np.array([codes.setdefault(v, len(codes)) for v in x], np.int32) for x in pair) for pair in pairs]
    todo = sorted(range(len(rows)), key=lambda i: (len(rows[i][1]), len(rows[i][0])))
    while todo:
        width = len(rows[todo[-1]][1]) + 1
        part, todo = todo[-max(1, most // width) :], todo[: -max(1, most // width)]
        na, nb = (np.array([len(rows[i][side]) for i in part]) for side in (0, 1))
        a, b = np.full((len(part), max(na.max(), 1)), -1, np.int32), np.full((len(part), width - 1), -2, np.int32)
        for r, i in enumerate(part):
            a[r, : na[r]], b[r, : nb[r]] = rows[i]
        step = np.arange(width)
        row = np.tile(step, (len(part), 1))
        ends = np.where(na == 0, nb, 0)
        for x in range(1, na.max(initial=0) + 1):
            new = row + 1
            np.minimum(new[:, 1:], row[:, :-1] + (b != a[:, x - 1 : x]), out=new[:, 1:])
            row = np.minimum.accumulate(new - step, axis=1) + step
            done = np.flatnonzero(na == x)
            ends[done] = row[done, nb[done]]
        out[part] = ends
    return out


class TopDown:
    """Least cost of turning one tree into another where whole subtrees come and go and parents are matched before their children: no less than the tree distance.

    Equal subtrees are one number, so each pair of different ones is asked once; equal children at both ends of two lists are matched as they are. What is known is
    forgotten beyond `most` entries. Below `deepest` levels, children are replaced as wholes, which costs no less.
    """

    def __init__(self, most: int = 500_000, deepest: int = 200):
        self.most, self.deepest = most, deepest
        self.forget()

    def forget(self):
        self.ids, self.kids, self.size, self.label, self.known = {}, [], [], [], {}

    def number(self, labels: list[str], leaves: list[int]) -> int:
        out: list[int] = []
        for i, (label, leaf) in enumerate(zip(labels, leaves)):
            children, c = [], i - 1
            while c >= leaf:
                children.append(out[c])
                c = leaves[c] - 1
            form = (label, *reversed(children))
            n = self.ids.setdefault(form, len(self.kids))
            if n == len(self.kids):
                self.kids.append(form[1:])
                self.size.append(i - leaf + 1)
                self.label.append(label)
            out.append(n)
        return out[-1]

    def cost(self, x: int, y: int, depth: int = 0) -> int:
        if x == y:
            return 0
        if (x, y) in self.known:
            return self.known[x, y]
        a, b, size = self.kids[x], self.kids[y], self.size
        end = min(len(a), len(b))
        low = next((i for i in range(end) if a[i] != b[i]), end)
        high = next((i for i in range(end - low) if a[-1 - i] != b[-1 - i]), end - low)
        a, b = a[low : len(a) - high], b[low : len(b) - high]
        row = [0]
        for v in b:
            row.append(row[-1] + size[v])
        if b and depth < self.deepest:
            for u in a:
                new = [row[0] + size[u]]
                for j, v in enumerate(b):
                    new.append(min(row[j + 1] + size[u], new[j] + size[v], row[j] + self.cost(u, v, depth + 1)))
                row = new
        else:
            row[-1] += sum(size[u] for u in a)
        self.known[x, y] = out = row[-1] + (self.label[x] != self.label[y])
        return out

    def __call__(self, a: tuple[list[str], list[int]], b: tuple[list[str], list[int]]) -> int:
        if len(self.known) + len(self.ids) > self.most:
            self.forget()
        return self.cost(self.number(*a), self.number(*b))


_TREES = T.StructType([T.StructField("page", T.LongType()), T.StructField("host", T.StringType()), T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("leaves", T.ArrayType(T.IntegerType())), T.StructField("branches", T.ArrayType(T.StringType()))])


def page_trees(pages: DataFrame) -> DataFrame:
    """(page, host, labels, leaves, branches, n, tree): every page's elements in post order, how many there are, and SHA-256 of the tree. Null html has the root alone."""

    def parse(batches):
        for batch in batches:
            trees = [post_order(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page"), batch.column("host"), pa.array([t[0] for t in trees], pa.list_(pa.string())), pa.array([t[1] for t in trees], pa.list_(pa.int32())), pa.array([branches(*t) for t in trees], pa.list_(pa.string()))],
                names=_TREES.names,
            )

    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    trees = pages.select(F.col("page_id").alias("page"), host.alias("host"), "html").mapInArrow(parse, _TREES)
    return trees.withColumn("n", F.size("labels").cast("bigint")).withColumn("tree", F.sha2(F.to_json(F.struct("labels", "leaves")), 256))


def page_classes(trees: DataFrame) -> DataFrame:
    """(host, tree, n, page, copies): pages of a host with one tree, as their smallest page and how many they are."""
    return trees.groupBy("host", "tree", "n").agg(F.min("page").alias("page"), F.count(F.lit(1)).alias("copies"))


def page_clones(trees: DataFrame) -> DataFrame:
    """(a, b, na, nb, copies_a, copies_b, distance, clone): pairs of classes of one host whose element counts are near, of any size and depth.

    Pages of one tree are one class, named by its smallest page, so copies make no pairs. The size prune is a range join on counts inside a host.
    Lower bounds come before any distance between trees: what the labels, counted with multiplicity, do not have in common; a fifth of what the profiles of
    binary branches (a label, its first child's, its next sibling's) do not, as an edit changes five of them at most; and the edit distances of the labels in
    both orders, parents first and parents last. Where one of them rules a clone out, distance is null. The trees that are left are compared once, however many hosts have them.
    `trees` is read from several sides and should be a written table.
    """
    sized = trees.where(F.col("n") >= knobs.MIN_NODES)
    classes = settle(page_classes(sized))
    near = band_pairs(classes, "host", "page", "n", *knobs.SIZE_RATIO).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    side = lambda x: classes.select(F.col("page").alias(x), F.col("n").alias(f"n{x}"), F.col("copies").alias(f"copies_{x}"), F.col("tree").alias(f"t{x}"))
    found = settle(near.join(side("a"), "a").join(side("b"), "b"))
    x, y = F.least("ta", "tb").alias("x"), F.greatest("ta", "tb").alias("y")
    tally = lambda c: F.map_from_entries(F.transform(F.array_distinct(c), lambda v: F.struct(v, F.size(F.filter(c, lambda w: w == v)))))
    first = sized.groupBy("tree").agg(*(F.first(c).alias(c) for c in ("labels", "leaves", "branches")))
    forms = settle(first.select("tree", "labels", F.col("leaves").alias("f"), tally("labels").alias("kinds"), tally("branches").alias("boughs")))
    tn, td = knobs.TREE_RATIO
    kinds = lambda k: forms.select(F.col("tree").alias(k), F.col("kinds").alias(f"k{k}"), F.col("boughs").alias(f"b{k}"), F.size("labels").alias(f"n{k}"))
    both = lambda p, q: F.aggregate(F.map_keys(p), F.lit(0), lambda t, k: t + F.least(F.col(p)[k], F.coalesce(F.try_element_at(q, k), F.lit(0))))
    larger = F.greatest("nx", "ny")
    apart = (F.col("nx") + F.col("ny") - 2 * both("bx", "by")) <= 5 * F.floor(larger * (td - tn) / td)
    sides = found.select(x, y).distinct().join(kinds("x"), "x").join(kinds("y"), "y")
    alike = sides.where(both("kx", "ky") * td >= larger * tn).where(apart).select("x", "y")
    whole = lambda k: forms.select(F.col("tree").alias(k), F.col("labels").alias(f"l{k}"), F.col("f").alias(f"f{k}"))
    rows = alike.join(whole("x"), "x").join(whole("y"), "y").select("x", "y", "lx", "fx", "ly", "fy")
    out = T.StructType([T.StructField("x", T.StringType()), T.StructField("y", T.StringType()), T.StructField("distance", T.LongType())])

    def judge(batches):
        above = TopDown()
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("lx", "fx", "ly", "fy"))))
            least = sequence_distances([(p, r) for p, _, r, _ in rows])
            near = [i for i, (p, _, r, _) in enumerate(rows) if (max(len(p), len(r)) - least[i]) * td >= max(len(p), len(r)) * tn]
            again = sequence_distances([(before_order(*rows[i][:2]), before_order(*rows[i][2:])) for i in near])
            d: list[int | None] = [None] * len(rows)
            for i, low in zip(near, np.maximum(again, least[near]).tolist()):
                p, q, r, s = rows[i]
                if (max(len(p), len(r)) - low) * td >= max(len(p), len(r)) * tn:
                    high = above((p, q), (r, s))
                    d[i] = high if high == low else tree_distance((p, q), (r, s))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(d, pa.int64())], names=out.names)

    # the pairs are dealt anew, as their arrays weigh little and their search much
    deal = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    judged = settle(rows.repartition(4 * deal).mapInArrow(judge, out))
    most = F.greatest("na", "nb")
    clone = F.coalesce((most - F.col("distance")) * td >= most * tn, F.lit(False))
    return found.select("*", x, y).join(judged, ["x", "y"], "left").select("a", "b", "na", "nb", "copies_a", "copies_b", "distance", clone.alias("clone"))
