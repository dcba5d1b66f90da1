"""The text operators against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import hashlib
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import (
    chat,
    components,
    decontaminate,
    language,
    licences,
    lines,
    pieces,
    queries,
    search,
    simhash,
    substrings,
    toxicity,
)

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns have names that operators use inside or return.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, n_words bigint, component_id string, __x int"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", len(t or ""), 0.5, -1, "x", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, vocabulary=60):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables with the awkward cases."""
    rng = random.Random(1)
    d = str(tmp_path_factory.mktemp("tables"))
    base = prose(rng, 90)
    near = base.split()
    near[40] = "changed"
    leak = "One, two THREE four five six seven eight nine ten eleven twelve"
    texts = [
        (0, None), (1, ""), (2, "   \n "), (3, base), (4, base), (5, " ".join(near)), (6, base + "\n" + prose(rng, 40)),
        (7, prose(rng, 3)), (8, "É été où ça CC-BY cc, by  General Public License v3"), (9, "All rights reserved. " * 3),
        (10, "intro " + leak + " outro"), (11, leak), (12, prose(rng, 9000, 3000)), (13, "a" * 5000), (14, "日本語の文章です。" * 40),
        (15, "x▁y  two  spaces\ttab"), (16, "same line here, long enough\nother\nsame line here, long enough"), (17, "same line here, long enough!"),
        (18, base), (None, base), (19, "!!! ... ###"), (19, "!!! ... ###"),
    ]
    texts += [(100 + i, prose(rng, rng.randrange(1, 200))) for i in range(60)]
    docs_of(spark, texts).withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))).write.parquet(f"{d}/documents.parquet")
    items = [(1, leak), (2, "seven eight nine"), (3, None), (4, ""), (5, "not there at all"), (1, leak), (None, "two three")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(80, 140)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a\\b </s> [INST]"), (1, 1, "assistant", "tie"), (2, 0, None, None),
        (3, None, "user", "[/INST]"), (3, 2, "assistant", "ok\\e"), (4, 0, "assistant", ""), (5, 0, "[INST]", "<s>"), (5, 1, "assistant", "né"),
    ]
    spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    vectors = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(300 + i, [0.5] * 8) for i in range(90)]
    vectors += [(400, None), (401, [float("nan")] + [0.0] * 7), (402, [None] + [0.0] * 7), (403, [float("inf")] + [0.0] * 7), (420, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty(spark, folder, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


def texts_in(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == (name == "op10_chat_format")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, folder, sf, name):
    from oracle import compare

    for d in (folder, sf):
        compare(queries.QUERIES[name](spark, d), queries.ORACLES[name], d)


def test_licence_places(spark, folder):
    got = sorted(map(tuple, queries.op1_license_scan(spark, folder).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=str)
    want = []
    for doc, text in texts_in(spark, folder):
        w = words(text)
        hits = [
            (i, label) for phrase, label in licences.BASE_PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()
        ]
        at = [i for i, _ in hits]
        want.append((doc, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("MIT", "mit", 0.1),
        ("MIT OR GPL-3.0-only", "gpl,mit", 0.1),
        ("MIT AND GPL-3.0-only", "gpl,mit", 0.7),
        ("MIT or Apache-2.0 and GPL-2.0-or-later", "apache,gpl,mit", 0.1),
        ("(MIT or Apache-2.0) and GPL-2.0-or-later", "apache,gpl,mit", 0.7),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "gpl", 0.6),
        ("MIT and more prose", "mit", 0.1),
        ("MIT and see the file", "mit", 0.1),
        ("Apache-2.0 or MIT with regard to", "apache,mit", 0.1),
        ("see the file", None, None),
        ("(MIT and see", None, None),
        ("(MIT", None, None),
        ("and MIT", None, None),
        ("", None, None),
    ],
)
def test_expressions(text, labels, score):
    value = licences.evaluate(text)
    if labels is None:
        assert value is None
    else:
        assert (",".join(sorted(value.labels)), round(value.restriction, 6)) == (labels, score)


def test_expression_of_tag():
    found = licences.scan(b"// SPDX-License-Identifier: (MIT OR Apache-2.0)\nand all rights reserved")
    assert found[4:6] == ("reserved", "apache,mit,reserved") and found[6] == 1.0
    assert licences.scan(b"spdx-license-identifier: and")[5] == "unparsed"
    assert licences.scan(b"the SPDX license identifier: MIT")[5] == ""
    tags = {
        "MIT AND ALL RIGHTS RESERVED": "mit,reserved", "MIT OR THE LICENSE": "mit", "MIT and e-mail me": "mit", "NONE": "", "NOASSERTION": "", "MIT and 3rd parties": "mit",
        "MIT AND RESERVED": "mit", "BSD-3-Clause OR GPL-2.0+ WITH Classpath-exception-2.0": "bsd,gpl", "LicenseRef-own and X11": "licenseref-own,x11", "USE IT": "unparsed",
    }
    for tag, labels in tags.items():
        assert licences.scan(f"// SPDX-License-Identifier: {tag}\n".encode())[5] == labels, tag
    long = " or ".join(f"LicenseRef-{i}" for i in range(900))
    assert len(licences.scan(b"SPDX-License-Identifier: " + long.encode())[5].split(",")) == 900


def test_many_licence_places_take_linear_time():
    import time

    start = time.perf_counter()
    found = licences.scan(b"cc by " * 200_000)
    assert found[1] == 200_000 and (found[2], found[3]) == (0, 399_998)
    assert time.perf_counter() - start < 20


def test_substrings(spark, folder):
    have = {d: (t or "").encode() for d, t in texts_in(spark, folder) if d is not None}
    want = substrings.brute(have)
    for r in queries.op2_substring_dedup(spark, folder).collect():
        if r.doc_id is None:
            assert r.n_removed == 0
            continue
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id]).hexdigest(), r.doc_id
        assert (r.n_bytes, r.n_removed) == (len(have[r.doc_id]), len(have[r.doc_id]) - len(want[r.doc_id]))


@pytest.mark.parametrize("hot", [False, True])
def test_substrings_at_random(spark, monkeypatch, hot):
    rng = random.Random(7)
    if hot:
        monkeypatch.setattr(substrings, "HOT", 1)
    parts = [bytes(rng.choice(b"ab") for _ in range(n)).decode() for n in (60, 99, 100, 101, 130, 250)] + ["a" * 150, "ab" * 90]
    texts = [(i, "".join(rng.choice(parts) + str(i) * rng.randrange(2) for _ in range(rng.randrange(6)))) for i in range(60)]
    got = {r.doc_id: bytes(r.kept) for r in substrings.dedup_substrings(docs_of(spark, texts)).collect()}
    assert got == substrings.brute({i: t.encode() for i, t in texts})


def test_search_ties_and_blocks(spark, folder):
    from oracle import compare

    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    got = search.exact_top_k(vectors, F.col("id") % 20 == 0, block_rows=50, query_rows=4)
    compare(got, queries.ORACLES["op3_topk_search"], folder)


def test_pieces(spark):
    v = pieces.load()
    rng = random.Random(3)
    score = {int(i): float(x) for k in v.by_length.values() for i, x in zip(k.ids, k.scores)}
    names = {v.pieces[i].decode().replace(" ", pieces.MARK): i for i in score}

    def best(chunk):
        top = [0.0] + [float("-inf")] * len(chunk)
        for j in range(1, len(chunk) + 1):
            for i in range(max(0, j - 16), j):
                if chunk[i:j] in names:
                    top[j] = max(top[j], top[i] + score[names[chunk[i:j]]])
            if chunk[j - 1] not in names:
                top[j] = max(top[j], top[j - 1] + v.least - pieces.UNKNOWN_PENALTY)
        return top[-1]

    texts = ["", "the cat", "  two  blanks ", "日本語 é\n\nx", "thonedle wheaanti", "".join(rng.choice("abc é\n") for _ in range(200))]
    assert [x.decode() for x in v.decode(*v.encode(texts))] == texts
    for w in ("".join(rng.choice("abcde日") for _ in range(1500)), "the" * 300, "a" * 999):  # long chunks alone, as all together
        assert v._alone(w)[0].tolist() == v._equal([w], len(w))[0].tolist()
    for t in ("the", "thonedle", "wheaanti", "ciónrauedo", "x日y"):
        got = v.encode([t])[0].tolist()
        total, run = 0.0, 0
        for i in got:
            if i in score:
                total += score[i]
                run = 0
            else:
                run += 1
        unknown = len(bytes(b"".join(v.pieces[i] for i in got if i not in score)).decode())
        assert total + unknown * (v.least - pieces.UNKNOWN_PENALTY) == best(pieces.MARK + t)


def test_pieces_round_trip(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    coded = pieces.encode(docs, ["doc_id", "text"])
    back = pieces.decode(coded.withColumnRenamed("text", "was"), ["doc_id", "was", "identical"])
    for r in back.collect():
        assert r.text == (r.was or "").replace(pieces.MARK, " ") and r.identical == (pieces.MARK not in (r.was or ""))


def test_toxicity_learns_and_is_whole(spark):
    rng = random.Random(9)
    texts = []
    for i in range(900):
        w = prose(rng, rng.randrange(5, 120)).split()
        if i % 3 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vilest", "vilen", "vilo", "grubby"]))
        texts.append((i, " ".join(w)))
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    more = [*texts, (1000, None), (1001, ""), (1002, "clean " * 20000 + "vilest"), (1003, "!!!")]
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs_of(spark, more), model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    right = sum((got[i] >= toxicity.THRESHOLD) == (i % 3 == 0) for i in range(600, 900))
    assert right >= 285
    assert got[1002] >= toxicity.THRESHOLD > max(got[1000], got[1001], got[1003])
    one_sided = toxicity.train(docs, labels.where("toxic = 1"))
    assert {r.toxicity for r in toxicity.score(docs, one_sided, ["doc_id"]).collect()} == {0.0}


def test_toxicity_learns_from_every_labelled_row(spark):
    rng = random.Random(4)
    # 2,600 rows of each class; the 100 marked ones of largest id hash hold a word of their own
    order = [r.id for r in spark.range(2600).orderBy(F.xxhash64(F.col("id").cast("string")), "id").collect()]
    late = set(order[-100:])
    texts = []
    for i in range(5200):
        w = prose(rng, 6).split()
        if i < 2600:
            w.insert(rng.randrange(len(w)), "grubby" if i in late else "vilest")
        texts.append((i, f"{' '.join(w)} n{i}"))
    labels = spark.createDataFrame([(i, int(i < 2600)) for i in range(5200)], "doc_id bigint, toxic int")
    asked = ["vilest one", "so grubby one", prose(rng, 6)]
    for rows in (toxicity.SHARD_ROWS, 1500):  # one shard, and several whose means are taken
        model = toxicity.train(docs_of(spark, texts), labels, shard_rows=rows)
        score = model.scores([t.encode() for t in asked])
        assert score[0] >= toxicity.THRESHOLD and score[1] >= toxicity.THRESHOLD > score[2], rows


def test_toxicity_learns_from_long_texts(spark):
    rng = random.Random(5)
    texts = [(i, prose(rng, 6000 if i % 4 == 0 else 30) + (" vilest" if i % 4 == 0 else "")) for i in range(160)]
    assert all(len(t) > 16_384 for i, t in texts if i % 4 == 0)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, toxic int")
    model = toxicity.train(docs_of(spark, texts), labels)
    assert model.fitted and model.scores([b"vilest"])[0] > model.scores([prose(rng, 30).encode()])[0]


def test_toxicity_training_leaves_nothing_on_the_driver(spark):
    rng = random.Random(6)
    texts = [(i, f"{prose(rng, 300, 6000)} {'vilest' if i % 3 == 0 else ''}") for i in range(240)]
    docs, labels = docs_of(spark, texts), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id bigint, toxic int")

    def free():  # of the driver's memory for blocks; the session is local, so there are no executors
        return spark.sparkContext._jsc.sc().getExecutorMemoryStatus().head()._2()._2()

    toxicity.train(docs, labels)
    before = free()
    kept = [toxicity.train(docs, labels) for _ in range(2)]
    until = time.time() + 10
    while before - free() > 1 << 20 and time.time() < until:  # blocks are let go in the background
        time.sleep(0.1)
    assert all(m.fitted and np.unique(m.embedding, axis=0).shape[0] > 10_000 for m in kept)  # the parameters are of some megabytes
    assert before - free() <= 1 << 20


def test_toxicity_does_not_depend_on_batches():
    rng = random.Random(2)
    texts = [prose(rng, n).encode() for n in (0, 1, 2, 3, 50, 400)]
    model = toxicity.fit([*texts * 3, b"bad w1", b"bad w2", b"bad"] * 4, ([0] * 18 + [1] * 3) * 4, ["en"] * 84)
    one = [float(model.scores([t])[0]) for t in texts]
    assert one == pytest.approx(model.scores(texts).tolist(), abs=1e-5)


def simple_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, folder):
    have = texts_in(spark, folder)
    prints = [simple_print(t) for _, t in have]
    ids = [d for d, _ in have]
    root = list(range(len(have)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations([k for k, d in enumerate(ids) if d is not None], 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            root[find(i)] = find(j)
    want = sorted(
        (str(d), f"{p:016x}", str(min(ids[k] for k in range(len(ids)) if ids[k] is not None and find(k) == find(i)) if d is not None else None))
        for i, (d, p) in enumerate(zip(ids, prints))
    )
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in queries.op6_simhash(spark, folder).collect())
    assert got == want


@pytest.mark.parametrize("tile, small", [(4096, 64), (16, 2), (4096, 1)])
def test_simhash_pairs(spark, monkeypatch, tile, small):
    monkeypatch.setattr(simhash, "PACKED", small)
    rng = random.Random(tile + small)
    prints = set()
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            for _ in range(rng.randrange(4)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "bits bigint, node bigint")
    got = dict(components.components(simhash.near_pairs(frame, "bits", "node", tile=tile)).collect())
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    assert {i: got.get(i, i) for i in range(len(prints))} == {i: find(i) for i in range(len(prints))}


def brute_lines(texts):
    at, first = [], {}
    for doc, text in sorted((d, t) for d, t in texts if d is not None and t is not None):
        for n, x in enumerate(text.split("\n")):
            x = x.strip(" \t\r\x0b\x0c")
            if x:
                at.append((doc, n, x))
                first.setdefault(x, (doc, n))
    only = list(first)
    sets = [lines.shingles(x.encode()) for x in only]
    root = list(range(len(only)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(only)), 2):
        if lines.alike(sets[i], sets[j]):
            root[find(i)] = find(j)
    head = {}
    for i, x in enumerate(only):
        head[find(i)] = min(head.get(find(i), first[x]), first[x])
    keep = set(head.values())
    return {(d, n) for d, n, _ in at if (d, n) in keep}


def test_lines(spark, folder):
    rng = random.Random(6)
    texts = texts_in(spark, folder)
    for i in range(40):
        x = list(f"the common line number one of this test, with some words more {i % 4} " * 2)
        x[rng.randrange(len(x))] = "#"
        texts.append((500 + i, "".join(x) + "\n\n" + prose(rng, 12)))
    keep = brute_lines(texts)
    for r in lines.dedup_lines(docs_of(spark, texts)).collect():
        if r.doc_id is None or r.text is None:
            assert r.n_removed == 0
            continue
        source = dict(t for t in texts if t[0] is not None)[r.doc_id]
        want = [x for n, x in enumerate(source.split("\n")) if not x.strip(" \t\r\x0b\x0c") or (r.doc_id, n) in keep]
        assert r.text == "\n".join(want), r.doc_id
        assert r.n_words == -1


def band_batches(keys, step):
    import pyarrow as pa

    rows = [(k, h, 10) for k, n in keys for h in range(n)]
    for i in range(0, len(rows), step):
        cols = zip(*rows[i : i + step])
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["key", "h", "size"])


@pytest.mark.parametrize("step", [1, 3, 7, 100])
def test_lines_in_tiles(spark, monkeypatch, step):
    monkeypatch.setattr(lines, "TILE", 3)
    keys = [(1, 1), (2, 2), (3, 10), (4, 3), (5, 4), (6, 1), (7, 7)]
    out = [r for b in lines._groups(band_batches(keys, step)) for r in b.to_pylist()]
    assert all(len(r["h"]) <= 3 for r in out)
    groups = spark.createDataFrame([(r["g"], r["g2"], r["tile"], r["h"]) for r in out], lines._GROUP)
    held = {}
    for r in lines._asked(groups).collect():
        held.setdefault((r.g, r.g2), ([], []))[r.side].append(r.h)
    seen = set()
    for left, right in held.values():
        seen |= {frozenset(p) for p in (itertools.product(left, right) if right else itertools.combinations(left, 2))}
    assert seen == {frozenset(p) for p in itertools.combinations(range(10), 2)}


@pytest.mark.parametrize("crossed", [False, True])
def test_line_links(crossed):
    import numpy as np

    rng = random.Random(4)
    texts, group, side = [], [], []
    for g in range(30):
        base = [rng.choice("abcdé日 ") for _ in range(rng.randrange(1, 200))]
        for k in range(rng.randrange(1, 9)):
            x = list(base)
            for _ in range(rng.randrange(4)):
                x[rng.randrange(len(x))] = rng.choice("xyz")
            texts.append("".join(x).encode())
            group.append(g)
            side.append(k % 2 if crossed else 0)
    order = sorted(range(len(texts)), key=lambda i: (group[i], side[i]))
    texts, group, side = [texts[i] for i in order], np.array(group)[order], np.array(side)[order]
    sets = [lines.shingles(t) for t in texts]
    pairs = [
        (i, j) for i, j in itertools.combinations(range(len(texts)), 2)
        if group[i] == group[j] and lines.alike(sets[i], sets[j]) and (side[i] != side[j] or side[group == group[i]].max() == 0)
    ]
    i, j = lines.linked(texts, group, side)
    assert set(zip(i.tolist(), j.tolist())) <= set(pairs)
    label = lambda edges: dict(zip(*(x.tolist() for x in components.union(np.array([a for a, _ in edges]), np.array([b for _, b in edges])))))
    assert label(list(zip(i, j))) == label(pairs)


def text_batches(texts, step):
    import pyarrow as pa

    for i in range(0, len(texts), step):
        yield pa.RecordBatch.from_arrays([pa.array(texts[i : i + step])], names=["text"])


@pytest.mark.parametrize("deal", [1, 200, 1 << 19])
def test_band_keys_travel_in_buckets(monkeypatch, deal):
    """A row for a bucket of keys, not for each key; what comes out are the keys of more than one line, as rows for each key would give."""
    monkeypatch.setattr(lines, "DEAL", deal)
    rng = random.Random(31)
    base = ["".join(rng.choice("abcdé日 ") for _ in range(rng.randrange(1, 90))).strip() or "x" for _ in range(40)]
    texts = ["\n".join([rng.choice(base), rng.choice(base) + "#", prose(rng, 9)]) for _ in range(60)]
    dealt = list(lines._bands(16)(text_batches(texts, 20)))
    assert all(b.num_rows <= 16 and b.column("bucket").to_pylist() == sorted(set(b.column("bucket").to_pylist())) for b in dealt)
    assert deal > 1 or len(dealt) == 3
    rows = sorted((r for b in dealt for r in b.to_pylist()), key=lambda r: r["bucket"])
    held = {}
    for part in (texts[i : i + 20] for i in range(0, 60, 20)):
        for x in {y for t in part for y in lines.lines_of(t.encode())}:
            for key in lines.band_keys([x])[0].tolist():
                held.setdefault(key, []).append((int(lines.line_hashes([x])[0, 0]), len(x)))
    for step in (1, 5, 1000):
        import pyarrow as pa

        batches = [pa.RecordBatch.from_pylist(rows[i : i + step], dealt[0].schema) for i in range(0, len(rows), step)]
        got = [r for b in lines._shared(batches) for r in b.to_pylist()]
        assert [r["key"] for r in got] == sorted(r["key"] for r in got)
        assert sorted((r["key"], r["h"], r["size"]) for r in got) == sorted((k, *x) for k, m in held.items() if len(m) > 1 for x in m)


def test_copies_fold_in_a_slice():
    import pyarrow as pa

    doc = [(5, 1, "b line\n\n a line"), (3, 9, "other\na line\na line"), (3, 2, "x\ny\na line "), (7, 1, "b line")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*doc)], names=["doc", "th", "text"])
    got = {r["h"]: (r["doc"], r["th"], r["line"]) for b in lines._locate([batch]) for r in b.to_pylist()}
    h = {x: int(lines.line_hashes([x])[0, 0]) for x in (b"a line", b"b line", b"other", b"x", b"y")}
    assert got == {h[b"a line"]: (3, 2, 2), h[b"b line"]: (5, 1, 0), h[b"other"]: (3, 9, 0), h[b"x"]: (3, 2, 0), h[b"y"]: (3, 2, 1)}
    assert sum(b.num_rows for b in lines._locate([batch])) == 5


def test_lines_of_many_groups_are_compared_once(monkeypatch):
    """Groups of different bands that share two alike lines: one comparison, whatever the groups are."""
    import pyarrow as pa

    rng = random.Random(32)
    a, other = (prose(rng, 60) for _ in range(2))
    text = {1: a, 2: a + " and more", 3: other}
    rows = [(g, g, 0, h, text[h].encode()) for g, members in enumerate([(1, 2), (1, 2, 3), (2, 1), (3, 2, 1), (3,)]) for h in members]
    compared = []
    alike = lines.Shingles.alike
    monkeypatch.setattr(lines.Shingles, "alike", lambda self, i, j: compared.extend(zip(i, j)) or alike(self, i, j))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["g", "g2", "side", "h", "text"])
    links = [(r["src"], r["dst"]) for b in lines._verify([batch]) for r in b.to_pylist()]
    assert links == [(2, 1)]
    assert len(compared) == 1


def test_sketches_of_long_lines_rule_out():
    """Of lines of hundreds of shingles, those far from 0.8 need no exact comparison, and those at 0.8 are never ruled out."""
    import numpy as np

    rng = random.Random(33)
    base = [rng.choice("abcdefghij ") for _ in range(1200)]
    texts = ["".join(base)]
    for n in (1, 5, 10, 15, 40, 45, 50, 60):
        x = list(base)
        for at in range(10, 1190, 1180 // n):
            x[at] = "#"
        texts.append("".join(x))
    sets = lines.Shingles([t.encode() for t in texts])
    brute = [lines.shingles(t.encode()) for t in texts]
    i, j = np.zeros(8, np.int64), np.arange(1, 9)
    possible, really = sets.possible(i, j), [lines.alike(brute[0], b) for b in brute[1:]]
    assert sets.alike(i, j).tolist() == really
    assert all(p for p, r in zip(possible, really) if r)
    assert really[:3] == [True] * 3 and not any(possible[4:])


def test_very_long_lines_and_a_hot_band(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1 << 20))
    texts = [(1, long), (2, long[:500_000] + "#" + long[500_000:]), (3, long[::-1])]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs_of(spark, texts)).collect()}
    assert got == {1: 0, 2: 1, 3: 0}
    sets = lines.Shingles([t.encode() for _, t in texts])
    assert sets.size[0] > 1_000_000


def test_recall_of_bands(spark):
    """Pairs at 0.8 or more that share a band; the promise is 0.9."""
    rng = random.Random(13)
    pairs = []
    while len(pairs) < 400:
        base = [rng.choice("abcdefghij ") for _ in range(rng.randrange(60, 400))]
        other = list(base)
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(len(other))] = "#"
        a, b = "".join(base).encode(), "".join(other).encode()
        if a != b and lines.alike(lines.shingles(a), lines.shingles(b)):
            pairs.append((a, b))
    keys = [(lines.band_keys([a])[0], lines.band_keys([b])[0]) for a, b in pairs]
    assert sum((x == y).any() for x, y in keys) >= 0.98 * len(pairs)


def longest(text, at, sample):
    n = 0
    while at + n < len(text) and text[at : at + n + 1] in sample:
        n += 1
    return max(1, n)


@pytest.mark.parametrize("block", [3, 16, 512])
def test_cross_parsing_equals_definition(monkeypatch, block):
    monkeypatch.setattr(language, "BLOCK", block)
    samples = {"a": "abab cabba bac", "b": "xyz zzyx yyx xz"}
    parser = language.parser_of(samples)
    for text in ("abba", "cab xyz", "qqq", "zyx zyx abab", "b" * 600):
        counts, size = parser.phrases([text])
        for k, name in enumerate(parser.names):
            n = i = 0
            while i < len(text):
                i += longest(text, i, samples[name])
                n += 1
            assert counts[0, k] == n, (text, name)


def test_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in queries.op8_language(spark, sf).collect()}
    held = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang]
    right = sum(got[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.9 * len(held) and all(got[r.doc_id].held_out for r in held)
    parser = language.train(docs)
    odd = docs_of(spark, [(1, None), (2, ""), (3, "123 ... !"), (4, "the and of the"), (5, "日本")])
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, parser, ["doc_id"]).collect()}
    assert out[1] == out[2] == out[3] == ("und", 0.0) and out[4][0] == "en" and out[5][0] != "und"
    assert set(language.parser_of({}).predict([b"abc"])[0]) == {"und"}


def test_decontamination_spans_and_passes(spark, folder):
    docs, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    whole = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench).collect() if r.doc_id is not None}
    split = {r.doc_id: r for r in decontaminate.decontaminate(docs, bench, most_windows=5).collect() if r.doc_id is not None}
    text = dict(texts_in(spark, folder))
    for doc, r in whole.items():
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (split[doc].n_words, split[doc].n_hit, sorted(split[doc]["items"]))
        cut = [(text[doc] or "").encode()[s.start : s.stop].decode() for s in r.spans]
        assert sum(len(words(c)) for c in cut) == r.n_hit
    assert whole[11].spans[0].start == 0 and whole[11].n_hit == 12
    clean = {r.doc_id for r in decontaminate.without_contaminated(docs, bench).collect()}
    assert clean == {d for d in text if d is None or whole[d].n_hit == 0}


def test_chat(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet")
    done = {r.conv_id: r for r in chat.format_chats(rows).collect()}
    assert all(r.identical for r in done.values())
    assert {c for c, r in done.items() if r.escaped} == {1, 3, 5}
    segments = chat.format_chats(rows).select("conv_id", "formatted", chat.loss_segments(F.col("formatted")).alias("s"))
    for r in segments.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("s"))).collect():
        assert "".join(x.text for x in r.s) == r.formatted
        assert r.loss == "".join(t.text for t in done[r.conv_id].parsed if t.role == "assistant")


def test_pipeline(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    # columns with the names of what stages use or return inside ride along
    for c in ("n_removed", "n_lines", "toxicity", "leaked", "kept", "row", "th", "n", "bits", "doc", "lines", "head", "component", "pieces"):
        docs = docs.withColumn(c, F.lit(f"my {c}"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns, name
        assert after.where("n_removed <> 'my n_removed' or kept <> 'my kept' or th <> 'my th'").count() == 0
        path = f"{folder}-{name}"
        after.write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
    ids = {r.doc_id for r in docs.collect()}
    assert not ids & {10, 11} and len(ids & {3, 4, 18}) <= 1
    assert corpus_pipeline.run(spark, folder).count() == docs.count()


def test_language_knows_every_learned_letter():
    rng = random.Random(8)
    script = lambda first, n: "".join(chr(first + i) for i in range(n))
    letters = {"en": script(97, 26), "ja": script(0x4E00, 300), "ko": script(0xAC00, 300), "zh": script(0x20000, 200), "zz": script(0x4E00, 300)}
    word = lambda of: "".join(rng.choice(of) for _ in range(3))
    vocabulary = {n: [word(of) for _ in range(60)] for n, of in letters.items()}
    say = lambda n, k: " ".join(rng.choice(vocabulary[n]) for _ in range(k))
    samples = {n: say(n, 900 if n == "en" else 200) for n in letters}
    parser = language.parser_of(samples)
    texts = [say(n, 40) for n in letters]
    assert parser.predict([t.encode() for t in texts])[0] == list(letters)
    for text in [*texts, texts[1] + "ॐ" + texts[3] + texts[0]]:
        counts, _ = parser.phrases([text])
        for k, name in enumerate(parser.names):
            n = i = 0
            while i < len(text):
                j = i + 1
                while j < len(text) and text[i : j + 1] in samples[name]:
                    j += 1
                i, n = j, n + 1
            assert counts[0, k] == n, name


def test_stages_on_empty_tables(spark, empty):
    import corpus_pipeline

    docs = spark.read.parquet(f"{empty}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, empty).count() == 0, name
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_one_id_with_two_texts(spark):
    rng = random.Random(31)
    block = prose(rng, 60)
    texts = [(1, "start " + block), (7, "ab" * 80), (7, "other " + block + " tail"), (7, "ab" * 80)]
    rows = substrings.dedup_substrings(docs_of(spark, texts)).collect()
    got = sorted((r.n_bytes, r.n_removed) for r in rows)
    other = len("other " + block + " tail")
    # within 160 bytes of period 2, strings from byte 2 on start earlier too
    assert [x for x in got if x[0] == 160] == [(160, 158), (160, 158)]
    assert [n for b, n in got if b == other][0] >= len(block)
    lined = lines.dedup_lines(docs_of(spark, [(1, "the first line of all, long enough"), (2, "x\nthe first line of all, long enough"), (2, "y only")])).collect()
    assert sorted((r.n_lines, r.n_removed) for r in lined) == [(1, 0), (1, 0), (2, 1)]
    near = {(r.bits, r.component_id) for r in simhash.near_duplicates(docs_of(spark, [(5, block), (5, prose(rng, 80)), (3, block)])).collect()}
    assert sorted(c for _, c in near) == [3, 5]


def test_search_of_large_components(spark):
    vectors = [(0, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1.0, 1.0]), (20, [3e6] * 2), (3, [-1e9, 5.0]), (4, [2.0])]
    frame = spark.createDataFrame(vectors, "vec_id bigint, v array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in search.exact_top_k(frame.where("vec_id <> 1 or true"), F.col("id") == 2, vector="v").collect()}
    whole = {i: [int(64 * x) for x in v] + [0] * (2 - len(v)) for i, v in vectors}
    assert got == {(2, i): sum(a * b for a, b in zip(whole[2], w)) for i, w in whole.items() if i != 2}
    import numpy as np

    x = np.array([[3e8, 1.0], [3e8, 2.0], [-3e8, 7.0]])
    q = np.array([[3e8, 1.0]])
    assert search._scores(q, x, np.array([search.NONE])).tolist() == [[9 * 10**16 + 1, 9 * 10**16 + 2, -9 * 10**16 + 7]]
    with pytest.raises(OverflowError):
        search._scores(q * 1e3, x * 1e3, np.array([search.NONE]))


def test_language_of_other_scripts(spark):
    import unicodedata

    say = {"el": "καλημέρα κόσμε τι κάνεις σήμερα", "ka": "გამარჯობა მსოფლიო როგორ ხარ დღეს", "zh": "你好世界今天怎么样我们去学校", "fr": "été déjà là où ça naïve élève", "en": "hello world how are you today"}
    rows = [(10 * k + i, f"{t} " * 30, lang) for k, (lang, t) in enumerate(sorted(say.items())) for i in range(3 if lang != "en" else 6)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    parser = language.train(docs)
    asked = [(k, t, None) for k, t in enumerate(say.values())] + [(9, unicodedata.normalize("NFD", say["fr"]), None), (10, "ひらがな だけ", None)]
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(asked, docs.schema), parser, ["doc_id"]).collect()}
    assert [out[k][0] for k in range(5)] == list(say) and out[9][0] == "fr"
    assert out[10] == ("en", 0.0)  # unknown to all: the language of most labelled rows, not the first by name


def test_held_out_is_never_null(spark, folder):
    for name in ("op5_toxicity", "op8_language"):
        assert queries.QUERIES[name](spark, folder).where("held_out is null").count() == 0


def test_toxicity_query_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables have some sixty labelled rows to learn from, too few
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op5_toxicity(spark, sf).collect() if r.held_out and r.doc_id in marks]
    assert sum(r.predicted == marks[r.doc_id] for r in got) >= 0.9 * len(got) and got
