"""Exact, near and substring duplicates against plain versions."""

import random

import llm_brute as brute
import numpy as np
import pyarrow as pa
import pytest

from churnlake.llm import exact, near, substrings
from churnlake.llm.scan import over_texts
from churnlake.session import stage

DATA = "/root/testdata/sf0.001"
EXTRA = "doc_id bigint, text string, kept string, place int, names string"


def odd_rows(seed, words=40, n=120):
    """Copies, near copies, shared passages, runs, blanks of all kinds, empty and long texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["é", "A", "a,", "日"]
    make = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, origin = make(60), make(200)
    texts = [None, "", " \t\n", "one", "One", "one two", "x " * 50, "x " * 500, " ".join(make(8000))]
    for _ in range(n):
        kind = rng.randrange(6)
        if kind == 0:
            w = make(rng.randint(0, words))
        elif kind == 1:
            w = make(20) + passage[rng.randint(0, 20) : rng.randint(30, 60)] + make(20)
        elif kind == 2:
            w = list(origin)
            for _ in range(rng.randint(0, 14)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        elif kind == 3:
            w = origin
        elif kind == 4:
            w = ["The"] * rng.randint(1, 40) + make(5)
        else:
            w = passage + passage + make(3)
        texts.append(rng.choice([" ", "\n", "  "]).join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 3 - 5, t) for i, t in zip(order, texts)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], EXTRA).repartition(5)


def test_exact_groups(spark):
    rows = odd_rows(1) + [(None, "one"), (None, "only here"), (-5, "twice"), (-5, "twice")]
    got = exact.exact_groups(frame(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute.exact(rows)))


@pytest.mark.parametrize("bits", [exact.MAP_BITS, 1 << 20])
def test_exact_groups_with_full_filter(spark, bits):
    """A filter far too small only sends more rows on."""
    rows = [(i, f"text {i // 2 if i < 3000 else i}") for i in range(40_000)] + [(40_000 + i, "hot") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = exact.exact_groups(docs, max_filter_bits=bits).groupBy("group_size", "kept").count().collect()
    assert {(r["group_size"], r["kept"]): r["count"] for r in got} == {
        (1, True): 37_000, (2, True): 1500, (2, False): 1500, (20_000, True): 1, (20_000, False): 19_999,
    }


def test_filter_lets_single_rows_pass(spark):
    docs = spark.createDataFrame([(i, f"text {max(i, 100)}") for i in range(5000)], "doc_id bigint, text string")
    digests = docs.selectExpr("doc_id", "unhex(sha2(text, 256)) as sha")
    bits = 1 << 17
    flagged = exact.may_repeat(digests, exact.repeat_filter(digests, bits), bits)
    assert flagged.where("may_repeat and doc_id > 100").count() < 250
    assert flagged.where("may_repeat and doc_id <= 100").count() == 101


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80), (1, 50)])
def test_near_duplicates(spark, width, percent):
    rows = odd_rows(2 + width)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(frame(spark, rows), width, percent).collect()}
    assert got == brute.near(rows, width, percent)


def test_near_duplicates_on_testdata(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(docs, 3, 85).collect()}
    assert got == brute.near(rows, 3, 85)


def test_large_nodes_and_a_chain(spark, monkeypatch):
    """Many near copies in nodes above the limit, and a chain whose ends are far apart."""
    monkeypatch.setattr(near, "NODE", 8)
    rng = random.Random(8)
    origin = [f"o{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(origin)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(150)] = f"n{rng.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    w = [f"c{i}" for i in range(150)]
    for i in range(30):
        rows.append((1000 - i, " ".join(w)))
        w[5 * i : 5 * i + 5] = [f"d{i}-{k}" for k in range(5)]
    got = {r["doc_id"]: r["component_id"] for r in near.near_duplicates(frame(spark, rows), 1, 85).collect()}
    assert got == {i: c for i, (_, c, _) in brute.near(rows, 1, 85).items()}
    assert got[1000] == 971


def test_equal_signatures_beyond_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(near, "NODE", 4)
    monkeypatch.setattr(near, "MAX_LEVEL", 4)
    rows = [(i, " ".join([f"o{k}" for k in range(400)] + [f"x{i}"])) for i in range(40)]
    got = near.near_duplicates(frame(spark, rows), 1, 85).where("component_id = 0").count()
    assert got == 40


def test_a_dealt_node_keeps_no_link_apart(spark, monkeypatch):
    """Pairs of near copies share most words with all others, not enough for a link; the smallest class has none."""
    monkeypatch.setattr(near, "NODE", 4)
    monkeypatch.setattr(near, "MAX_LEVEL", 4)
    base = [f"o{k}" for k in range(160)]
    rows = [(0, " ".join(base + [f"a{k}" for k in range(60)]))]
    for i in range(1, 41):
        own = [f"p{i}-{k}" for k in range(50)]
        rows += [(10 * i, " ".join(base + own)), (10 * i + 1, " ".join(base + own[:-3] + [f"q{i}"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.near_duplicates(frame(spark, rows), 1, 85).collect()}
    want = brute.near(rows, 1, 85)
    assert got == want and len({c for _, c, _ in want.values()}) == 41


def test_components(spark):
    pairs = [(5, 3), (9, 5), (7, 9), (20, 21), (21, 22), (30, 31), (40, 30), (3, 5)]
    got = near.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {r[0]: r[1] for r in got} == {3: 3, 5: 3, 7: 3, 9: 3, 20: 20, 21: 20, 22: 20, 30: 30, 31: 30, 40: 30}
    assert near.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_missing_ids_and_repeated_rows(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (None, "f g h i j"), (2, None)]
    got = near.near_duplicates(frame(spark, rows), 3, 85).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(
        map(repr, [(None, 3, 4, False), (4, 3, 4, True), (4, 3, 4, True), (None, 3, None, False), (2, 0, 2, True)])
    )
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(None, long), (4, long), (4, long), (6, long), (None, "x")]
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert sorted((repr(r["doc_id"]), r["n_words"], r["n_removed"]) for r in got) == [
        ("4", 20, 0), ("4", 20, 0), ("6", 20, 20), ("None", 1, 0), ("None", 20, 0),
    ]


def test_one_id_with_several_texts(spark):
    """Each text of an id is judged on its own, and none by another of the same id."""
    long = " ".join(f"w{i}" for i in range(20))
    rows = [(4, long), (4, "short"), (4, "x " + long + " y z"), (4, "short"), (6, "a b c"), (6, long + " end"), (6, None), (9, "a b c")]
    got = substrings.remove_repeats(frame(spark, rows), with_text=True).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == sorted(
        [(4, 20, 0, long), (4, 1, 0, "short"), (4, 1, 0, "short"), (4, 23, 0, "x " + long + " y z"), (6, 3, 0, "a b c"),
         (6, 21, 20, "end"), (6, 0, 0, ""), (9, 3, 0, "a b c")]
    )


@pytest.mark.parametrize("seed, window", [(11, 13), (12, 13), (13, 11), (14, 20)])
def test_remove_repeats(spark, seed, window):
    rows = odd_rows(seed)
    got = substrings.remove_repeats(frame(spark, rows), window, with_text=True).collect()
    want = brute.repeats(rows, window)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in got} == want
    assert all(r["kept_sha256"] == brute.sha(want[r["doc_id"]][2]) for r in got)
    assert sum(r["n_removed"] for r in got) > 500


def test_remove_repeats_across_tasks_and_groups(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GROUP_BYTES", 2000)
    rows = odd_rows(21, n=200)
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in got} == {i: w[:2] for i, w in brute.repeats(rows, 13).items()}


def test_boundaries_depend_on_neighbours_only():
    """Equal passages have equal symbol boundaries from two words inside, at most four words apart."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        inner = rng.integers(0, 50, 13, dtype=np.uint64) * np.uint64(977)
        looks = []
        for _ in range(3):
            outer = [rng.integers(0, 50, 20, dtype=np.uint64) * np.uint64(977) for _ in range(2)]
            looks.append(substrings.boundaries(np.concatenate([outer[0], inner, outer[1]]))[22:31])
        assert (looks[0] == looks[1]).all() and (looks[0] == looks[2]).all()
        assert np.diff(np.flatnonzero(np.concatenate([[True], looks[0], [True]]))).max() <= 5


def test_empty_tables(spark):
    empty = frame(spark, [(1, "a")]).where("false")
    for made in (exact.exact_groups(empty), near.near_duplicates(empty), substrings.remove_repeats(empty)):
        assert made.collect() == []


def test_rows_of_a_node_come_together_across_batches():
    """Nodes that end, cross or fill batches; no batch stays in memory for a later one."""
    nodes = np.repeat([1, 2, 3, 4, 5, 9], [3, 1, 9, 2, 1, 4])
    whole = pa.record_batch({"node": pa.array(nodes), "shingles": pa.array([[i] * 1000 for i in range(len(nodes))])})
    for width in (1, 2, 4, 7, 20):
        parts = [whole.slice(a, width) for a in range(0, len(nodes), width)] + [whole.slice(0, 0)]
        got = list(near._by_node(iter(parts)))
        assert [set(g.column("node").to_pylist()) for g in got] == [{1}, {2}, {3}, {4}, {5}, {9}]
        assert [s[0] for g in got for s in g.column("shingles").to_pylist()] == list(range(len(nodes)))

    before = pa.total_allocated_bytes()

    def fresh():
        for a in range(200):
            yield pa.record_batch({"node": pa.array([a * 10 + i // 10 for i in range(100)]), "shingles": pa.array([[a] * 1000] * 100)})

    most = max(pa.total_allocated_bytes() - before for _ in near._by_node(fresh()))
    assert most < 2_000_000  # a batch is 0.8 MB


def test_full_sets_leave_in_small_batches(spark):
    df = spark.createDataFrame([(i, f"a b c d{i}") for i in range(1300)], "doc_id bigint, text string").coalesce(1)
    ids = stage(df.select("doc_id"), "ids")
    sets = near._sets(df, ids, 3)
    sizes = over_texts(df, lambda texts: {"n": pa.array([len(texts)] * len(texts), pa.int64())}, "doc_id bigint, n bigint", rows=500)
    seen = {r["n"] for r in sizes.select("n").distinct().collect()}
    assert seen == {500, 300} and sets.count() == 1300 and sets.where("size(shingles) = 2").count() == 1300
