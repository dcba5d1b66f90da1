"""Spelling variants, packing and ranked search against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, extra columns."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from oracle import compare

from sparkloom.llm import packing, queries, ranking, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Extra columns have names that operators use inside or return.
DOCS = "doc_id bigint, text string, word string, n bigint, length bigint, m int, score double, kept string, term string"
ITEMS = "item_id bigint, text string, item string, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 0.5, "k", "t") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    stems = ["wording", "neighbour", "colour", "éclairage", "straße", "mississippi", "aaaaaaa", "commonly"]

    def word():
        w = rng.choice(stems) if rng.random() < 0.7 else "v" + "".join(rng.choice("abcx") for _ in range(6))
        if rng.random() < 0.3:
            p = rng.randrange(len(w))
            w = rng.choice([w[:p] + w[p + 1 :], w[:p] + "q" + w[p:], w[:p] + "z" + w[p + 1 :], w.upper()])
        return w

    rows = [(i, " ".join(word() for _ in range(rng.randrange(1, 120)))) for i in range(150)]
    long = "a" * 30_000
    rows += [(900, None), (901, ""), (902, " \n!!"), (903, rows[0][1]), (904, rows[0][1]), (904, rows[0][1]), (None, rows[1][1]), (None, None)]
    rows += [(905 + i, long + ("b" if i % 2 else "")) for i in range(12)]
    rows += [(920, "日本語 × ÷ <|endoftext|> ՘x " * 30), (921, " ".join(word() for _ in range(8000)))]
    return rows


@pytest.fixture(scope="module")
def folder(spark, texts, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("variants"))
    table(spark, texts).repartition(3).write.parquet(f"{d}/documents.parquet")
    items = [(1, "Wording of the NEIGHBOUR"), (2, "colour colour éclairage"), (2, "commonly"), (3, None), (4, ""), (5, "never-there"), (None, "aaaaaaa straße")]
    items += [(10 + i, texts[i][1][:200]) for i in range(20)]
    spark.createDataFrame([(i, t, "x", 9) for i, t in items], ITEMS).write.parquet(f"{d}/benchmark.parquet")
    return d


def variants(rows, least=5):
    counts = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    n = {w: c for w, c in counts.items() if c >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[p:] == b[p + 1 :]

    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in around.items() if xs}
    form = {w: f for w, f in form.items() if n[f] >= 5 * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), c, len(around[w]), n[form[w]] if w in form else None) for w, c in n.items()}


@pytest.mark.parametrize("tile", [4096, 6])
def test_variants_are_those_of_all_pairs(spark, folder, texts, tile):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = spelling.spelling_groups(docs, tile=tile).select("word", "form", "root", "n", "n_near", "form_n")
    rows = [tuple(r) for r in got.collect()]
    want = variants(texts)
    assert len(rows) == len(want) and set(rows) == want
    assert any(r[1] for r in want) and any(len(r[0]) > 10_000 for r in want)


def test_op11_on_a_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op11_spelling_groups(spark, sf).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == variants(rows)


def test_blocks_of_several_sizes_find_each_pair_once():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice((8, 9)))).encode() for _ in range(600)})
    n = len(words)
    a, b = spelling.near_in_groups(words, np.ones(n), 8, np.zeros(n, int), np.full(n, 8), np.zeros(n, int))
    found = collections.Counter(frozenset(p) for p in zip(a.tolist(), b.tolist()))

    def near(x, y):
        if len(x) == len(y) == 8:
            return sum(p != q for p, q in zip(x, y)) == 1
        x, y = sorted((x, y), key=len)
        return len(x) + 1 == len(y) and any(y[:i] + y[i + 1 :] == x for i in range(9))

    want = {frozenset((i, j)) for i in range(n) for j in range(i) if near(words[i], words[j])}
    assert set(found) == want and set(found.values()) == {1}


@pytest.mark.parametrize("size", [1 << 21, 3000])
def test_packing_is_whole_and_gapless(spark, folder, texts, size):
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "row_number() over (order by doc_id, text) as row")
    rows = packing.pack_documents(docs, ["doc_id", "row", "text"], round_tokens=size).collect()
    check_packing([(r["row"], r["text"], r) for r in rows], len(texts))


def check_packing(rows, documents):
    """`rows`: (name of the document, its text, piece)."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.TOKENIZER)
    by_doc, by_sequence, text = collections.defaultdict(list), collections.defaultdict(list), {}
    for name, t, r in rows:
        by_doc[name].append(r)
        by_sequence[r["sequence_id"]].append(r)
        text[name] = t or ""
    assert len(by_doc) == documents
    for name, held in by_doc.items():
        held.sort(key=lambda r: r["start"])
        ids = plain.encode(text[name], add_special_tokens=False).ids + [1]
        at = 0
        for r in held:
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert bytes(r["ids"]) == np.array(ids[at : at + r["length"]], "<u4").tobytes()
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        held.sort(key=lambda r: r["offset"])
        at = 0
        for r in held:
            assert r["offset"] == at
            at += r["length"]
        assert at & (at - 1) == 0 and at <= 2048 and {r["context"] for r in held} == {at}
    return by_sequence


def test_op12_on_a_given_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = packing.pack_documents(docs, ["doc_id", "text"]).collect()
    sequences = check_packing([(r["doc_id"], r["text"], r) for r in made], docs.count())
    short = sum(1 for s in sequences.values() if s[0]["context"] < 128)
    assert short <= 7 * docs.rdd.getNumPartitions()
    groups = collections.Counter()
    for held in sequences.values():
        groups[held[0]["step_group"]] += held[0]["context"]
    assert max(groups.values()) - min(groups.values()) <= 2048
    whole = {r["doc_id"] for r in made if r["length"] == r["doc_tokens"]}
    assert len(whole) > 0.6 * docs.count()
    digest = queries.op12_packing(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    ids = {}
    for r in made:
        ids.setdefault(r["doc_id"], {})[r["start"]] = bytes(r["ids"])
    whole_ids = {d: b"".join(x for _, x in sorted(p.items())) for d, p in ids.items()}
    for r in digest:
        part = whole_ids[r["doc_id"]][4 * r["start"] : 4 * (r["start"] + r["length"])]
        assert len(part) == 4 * r["length"] and zlib.crc32(part) == r["ids_crc32"]


def test_packs_of_any_lengths():
    for seed in range(60):
        rng = random.Random(seed)
        lengths = [rng.choice([1, 2, rng.randrange(1, 100), rng.randrange(1, 3000), rng.randrange(1, 20000)]) for _ in range(rng.randrange(0, 120))]
        done, rest = packing.pack(lengths, last=False)
        assert sum(n for *_, n in rest) < 2048 and all(sum(n for *_, n in s) in packing.TIERS for s in done)
        assert sorted((d, k) for s in [*done, rest] for d, a, n in s for k in range(a, a + n)) == [(d, k) for d, n in enumerate(lengths) for k in range(n)]


def test_encoder_splits_as_the_tokenizer_does(monkeypatch):
    with open(packing.TOKENIZER, encoding="utf-8") as file:
        encoder = packing.Encoder(file.read())
    monkeypatch.setattr(packing, "CUT", 60)
    every = ["".join(f"a{chr(c)}b {chr(c)}1 {chr(c)}{chr(c)} " for c in range(a, a + 256) if not 0xD800 <= c < 0xE000) for a in range(0, 0x20000, 256)]
    every += ["it's We'll 'S", "\n\n  two \t lines\n", "x" * 500, "<|endoftext|> <|endoftext|", "", " ", "  ", " a", "a ", "\n a"]
    every += ["".join(p) for n in range(1, 7) for p in itertools.product(" a\n\xa0", repeat=n)]
    plain = [e.ids for e in encoder.tokenizer.encode_batch(every, add_special_tokens=False)]
    assert [x.tolist() for x in encoder(every)] == plain


def ranked(rows, items, k=50):
    docs = [(i, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for i, t in rows]
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER)))
    count, length = sum(1 for _, w in docs if w), sum(len(w) for _, w in docs)
    counted = [(i, len(w), collections.Counter(w)) for i, w in docs]
    df = collections.Counter(t for _, _, c in counted for t in c)
    out = set()
    for item, terms in asked.items():
        scores = []
        for n, (i, size, c) in enumerate(counted):
            m = 50 + 50 * size * count // length
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0, n))
        out |= {(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("seed_from,most_terms", [(100_000, 200_000), (10, 40)])
def test_ranks_are_those_of_all_scores(spark, folder, texts, seed_from, most_terms, monkeypatch):
    monkeypatch.setattr(ranking, "SEED_SHARE", 2)
    docs, items = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    got = ranking.ranked_search(docs, items, seed_from=seed_from, most_terms=most_terms)
    rows = sorted(map(tuple, got.collect()), key=str)
    want = ranked(texts, [tuple(r) for r in items.select("item_id", "text").collect()])
    assert rows == sorted(want, key=str) and len(want) > 500


def test_op13_equals_sql(spark, sf, folder):
    for d in (sf, folder):
        compare(queries.op13_ranked_search(spark, d), queries.OP13_SQL, d)


def test_blocks_are_passed_over_and_nothing_is_lost():
    rng = np.random.default_rng(2)
    docs, terms = 2000, 60
    topic = rng.integers(0, 12, docs)
    lists = [np.unique(np.concatenate([rng.integers(0, 12, 3), 12 + topic[i] * 4 + rng.integers(0, 4, 3)])) for i in range(docs)]
    size = np.array([len(x) for x in lists])
    term = np.concatenate(lists)
    tf = rng.integers(1, 4, len(term))
    weight = np.where(np.arange(terms) < 12, 50, 4000 + np.arange(terms))
    shard = ranking.Shard(np.arange(docs), rng.integers(60, 200, docs), size, term, tf, weight)
    items = [np.array(sorted({12 + 4 * t, 13 + 4 * t, 0, 3, 5}, key=lambda x: -weight[x])) for t in range(12)]
    holders = [np.array([i for i, x in enumerate(items) if t in x]) for t in range(terms)]
    best = ranking.Best(np.ones(12, np.int64), 50)
    opened = ranking.search_shard(shard, items, holders, best)
    for i, x in enumerate(items):
        w = np.where(np.isin(np.arange(terms), x), weight, 0)
        score = shard.scores(np.arange(docs), w)
        want = np.lexsort([np.arange(docs), -score])[:50]
        assert best.top[i][1].tolist() == want.tolist() and best.top[i][0].tolist() == score[want].tolist()
    every = sum(-(-(shard.first[t + 1] - shard.first[t]) // ranking.BLOCK) * len(holders[t]) for t in range(terms))
    assert opened < 0.4 * every


def test_empty_tables(spark, tmp_path):
    d = str(tmp_path)
    table(spark, []).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], ITEMS).write.parquet(f"{d}/benchmark.parquet")
    for name in ("op11_spelling_groups", "op12_packing", "op13_ranked_search"):
        assert queries.QUERIES[name](spark, d).collect() == []


def test_languages_beyond_the_bound_do_not_end_the_job(spark):
    from sparkloom.llm import language

    rows = [(i, f"alpha beta gamma {i % 7}", "aa") for i in range(30)] + [(100 + i, f"zeta theta iota {i % 5}", "bb") for i in range(20)]
    rows += [(1000 + i, f"q{i} dirt", f"x{i}") for i in range(language.MOST_LANGS + 20)]
    parser = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert len(parser.names) == language.MOST_LANGS and {"aa", "bb"} <= set(parser.names)


def test_a_short_sample_is_weighed():
    from sparkloom.llm import language

    rng = random.Random(1)
    # close languages: the same words, some of them changed
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(150)]
    other = [w if i % 4 else w[::-1] + "o" for i, w in enumerate(words)]
    say = lambda ws, n: " ".join(rng.choice(ws) for _ in range(n))
    parser = language.parser_of({"one": say(words, 3000), "two": say(other, 150)})
    texts = [say(ws, 60).encode() for ws in (words, other) for _ in range(40)]
    names, _ = parser.predict(texts)
    right = sum(n == ("one" if i < 40 else "two") for i, n in enumerate(names))
    counts, _ = parser.phrases([t.decode() for t in texts])
    plain = sum(int(c[1] < c[0]) == (i >= 40) for i, c in enumerate(counts))
    assert right >= 70 and right >= plain
