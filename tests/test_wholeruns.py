"""Runs with all places paired, made and counted by their ends, against SQL on tables with odd texts."""

import random

import numpy as np
import pytest
from oracle import compare

from sparkloom.operators import wholeruns
from sparkloom.plans import registry


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Copies, copies of copies with changed words, passages that come twice, words that come round, short, empty and null texts, null ids."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(400)}"
    base = [[word() for _ in range(rng.choice([30, 60, 120, 200]))] for _ in range(6)]
    passage = [word() for _ in range(55)]
    texts = []
    for _ in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = word()
        if rng.random() < 0.4:
            at = rng.randrange(len(t))
            t[at:at] = passage * rng.choice([1, 2])
        if rng.random() < 0.3:
            t += [f"r{i % rng.choice([1, 3, 6, 7, 9])}" for i in range(rng.randrange(90))]
        texts.append(" ".join(t))
    for turn in (1, 2, 6, 7, 8, 30):
        texts += [" ".join(f"r{i % turn}" for i in range(n)) for n in (24, 25, 49, 50, 51, 75, 140)]
    rows = [(i, x) for i, x in enumerate([*texts, None, "", "one two"])] + [(None, texts[0]), (None, texts[0])]
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["clone_blocks_whole", "clone_near_misses_whole", "clone_groups_whole"])
def test_equals_sql_on_odd_texts(spark, odd, name):
    compare(registry.QUERIES[name](spark, odd), registry.ORACLES[name], odd)


def test_a_pair_of_runs_costs_its_ends(spark):
    """Of sixty copies of one long text only the ends are dealt out, not all of its places."""
    text = " ".join(f"w{i}" for i in range(600))
    docs = spark.createDataFrame([(i, text) for i in range(60)], "doc_id bigint, text string")
    rows = wholeruns._edges(docs, 25, 26, 7)
    assert rows.where("next is null").count() == 120 and rows.count() <= 60 * 2 * 26
    runs = wholeruns.whole_runs(docs, 25, 50, 7)
    assert runs.count() == 60 * 59 // 2 and runs.where("tokens = 600 and n_distinct = 576").count() == 60 * 59 // 2


def test_line_runs_equal_sql(spark, tmp_path):
    rng = random.Random(8)
    line = lambda: rng.choice(["", " - ", "a common line in many documents", *(f"line {i}" for i in range(12))])
    rows = [(i, "\n".join(line() for _ in range(rng.randrange(14)))) for i in range(60)]
    rows += [(100 + i, "\n".join(f"copied {j}" for j in range(200))) for i in range(4)] + [(200, None), (None, rows[0][1])]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    deal, wholeruns.DEAL_FROM = wholeruns.DEAL_FROM, 10
    try:
        found = registry.QUERIES["moved_blocks_whole"](spark, str(tmp_path))
        compare(found, registry.ORACLES["moved_blocks_whole"], str(tmp_path))
    finally:
        wholeruns.DEAL_FROM = deal
    assert found.where("a >= 100 and n = 200").count() == 6


def test_grams_of_one_digest_count_as_in_sql(spark, tmp_path):
    """The md5s of these two grams agree in their first 48 bits."""
    rows = [(i, f"w{n} " + " ".join(["x"] * 24)) for i, n in enumerate((8232508, 28494288))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = registry.QUERIES["clone_near_misses_whole"](spark, str(tmp_path))
    assert found.first().near_misses == 1
    compare(found, registry.ORACLES["clone_near_misses_whole"], str(tmp_path))


def test_stretches_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(200):
        grams = rng.integers(0, rng.integers(1, 12), rng.integers(1, 40))
        last = wholeruns.before(grams)
        assert [max((j for j in range(i) if grams[j] == grams[i]), default=-1) for i in range(len(grams))] == last.tolist()
        least, kinds = rng.integers(1, 9, 2)
        want = [next((e for e in range(s + least, len(grams) + 1) if len(set(grams[s:e].tolist())) >= kinds), -1) for s in range(len(grams))]
        assert wholeruns.varied(last, least, kinds).tolist() == want
        t = rng.integers(-(1 << 63), 1 << 63, 3)[rng.integers(0, 3, 30)]
        h = wholeruns.Spans(t)
        a, b = np.array([(i, j) for i in range(30) for j in range(i + 1, 31)]).T
        seen = {}
        assert all(seen.setdefault(x, tuple(t[i:j])) == tuple(t[i:j]) for x, i, j in zip(h(a, b).tolist(), a, b)) and len(seen) == len(set(seen.values()))
        first, lane, size = rng.integers(0, 9, (3, 20))
        inside = lambda i, j: size[j] > size[i] and first[j] <= first[i] and first[j] + size[j] >= first[i] + size[i] and first[j] + lane[j] <= first[i] + lane[i] and first[j] + lane[j] + size[j] >= first[i] + lane[i] + size[i]
        assert wholeruns.outermost(first, lane, size).tolist() == [not any(inside(i, j) for j in range(20)) for i in range(20)]
