"""Rank vocabularies against the library; conversation tries and lexical search against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from churnlake.llm import bytebpe, conversations, lexical, pretokens

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
BITS = [
    "'", "s", "t", "re", "ve", "l", "ll", "d", "m", " ", "  ", "\n", "\t", "a", "B", "é", "中", "1", "٣", "!", "?", " ", " ",
    "😀", "\x1c", "\x85", "ſ", "'S", "é", "​", "\r\n", "_", "²", "Ⅷ", "\x00", "don't", "'re", "they've'll",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    out += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(80)) for _ in range(100)]
    return out + ["", " ", "'", "\n", " a", "a ", "x" * 3000, "ab" * 3000, " " * 2000, "é" * 700, "'" * 60, "\n" * 99 + "a", "a b " * 500_000]


def test_rank_encoder_equals_library(vocabulary, library, texts):
    ours = bytebpe.Encoder(vocabulary)
    for at in range(0, len(texts), 400):
        some = texts[at : at + 400]
        group = ours.split(some)
        for text, (words, offsets) in zip(some, group.texts()):
            assert b"".join(group.raw[w] for w in words) == text.encode()
            ids = b"".join(group.packed[w] for w in words)
            assert np.frombuffer(ids, dtype="<i4").tolist() == library.encode_ordinary(text)
            assert offsets.tolist() == np.cumsum([0] + [len(group.raw[w]) for w in words])[:-1].tolist()


def test_pieces_that_share_a_name(vocabulary, library, texts, monkeypatch):
    """Names are a means to sort pieces out: results don't change when they collide."""
    def poor(data, starts, ends, values=None):
        return (ends - starts).astype(np.uint64) if values is None else data[starts].astype(np.uint64)

    monkeypatch.setattr(bytebpe, "hash_spans", poor)
    group = bytebpe.Encoder(vocabulary).split(texts[:200])
    for text, (words, _) in zip(texts, group.texts()):
        assert np.frombuffer(b"".join(group.packed[w] for w in words), dtype="<i4").tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("window", [3, 64, 1000])
def test_windows_of_the_scan_change_nothing(texts, window, monkeypatch):
    classes = pretokens.code_point_classes()
    some = texts[:300]
    whole = pretokens.pieces(some, classes)
    monkeypatch.setattr(pretokens, "WINDOW", window)
    assert pretokens.pieces(some, classes)[1].tolist() == whole[1].tolist()


def test_scan_equals_stepping():
    """The blocked scan gives the states that reading one symbol after another gives."""
    numbers, *_ = pretokens._monoid()
    rng = random.Random(3)
    symbols = [rng.randrange(9) for _ in range(5000)]
    state, want = pretokens.FRESH, []
    for s in symbols:
        want.append(state)
        state = pretokens._step(state, s)[1]
    got, last = pretokens.states_before(numbers[symbols], pretokens.FRESH)
    assert got.tolist() == want and last == state


def test_long_and_short_pieces_merge_alike(vocabulary, monkeypatch):
    ours = bytebpe.Encoder(vocabulary)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh日é") for _ in range(rng.randint(2, 40))).encode() for _ in range(500)]
    together = ours.merged(words)
    monkeypatch.setattr(bytebpe, "LONG_PIECE", 1)
    assert all((a == b).all() for a, b in zip(ours.merged(words), together))


def test_round_trip_and_parts_of_texts(spark, library, texts):
    some = texts[:300] + texts[-12:]
    rows = [(i, t, 0) for i, t in enumerate(some)] + [(0, some[0], 0), (None, "a b", 0), (-1, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids int").repartition(5)
    got = collections.Counter(map(tuple, bytebpe.round_trip(docs, PATH).collect()))
    want = collections.Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        line = ",".join(map(str, ids))
        want[i, len(ids), hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest()] += 1
    assert got == want
    encoded = bytebpe.encode_texts(docs, PATH)
    for start, stop in ((0, None), (2, 9), (5, 6), (40, None), (7, 7)):
        parts = sorted(((r["doc_id"], bytes(r["raw"])) for r in bytebpe.decode_ids(encoded, PATH, start, stop).collect()), key=str)
        assert parts == sorted(((i, (t or "").encode()[start:stop]) for i, t, _ in rows), key=str)
    assert bytebpe.round_trip(docs.where("false"), PATH).collect() == []


# Conversations


def plain_trie(rows):
    """Node rows by inserting whole conversations into a dictionary of prefixes."""
    by_id = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = (turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest())
            by_id[c].append((key, (role or "", text or "")))
    turns = {c: [t for _, t in sorted(some, key=lambda x: x[0])] for c, some in by_id.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        built[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, some in built.items():
        ends[some].append(c)
        for d in range(len(some) + 1):
            members[some[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (
            (min(who), len(p), min(members[p[:-1]]) if p else None, len(who), children[p], leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
            for p, who in members.items()
        ),
        key=str,
    )


def random_conversations(rng, n, alphabet, most):
    rows = []
    for c in rng.sample(range(-150, 400), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "bot"]) if t % 2 else "user", rng.choice(alphabet)))
    return rows


@pytest.mark.parametrize("trial", range(4))
def test_trie_equals_plain_version(spark, trial, monkeypatch):
    rng = random.Random(trial)
    rows = random_conversations(rng, 120, ["", "a", "é😀", "bc d", None][: 2 + trial], [4, 9, 30, 12][trial])
    rows += [(1000 + i, t, "user", "hot") for i in range(60) for t in range(7)]  # copies
    rows += [(2000, t, "u", "ab"[t % 2]) for t in range(300)] + [(2001, t, "u", "ab"[t % 2]) for t in range(290)]  # long ones
    rows += [(5, None, "user", "first"), (5, 1, None, "x"), (5, 1, None, "x"), (5, 1, "a", "y"), (None, 0, "user", "no id"), (7, 1, "u", None)]
    if trial:  # segments and batches of any size give the same trie
        monkeypatch.setattr(conversations, "SEGMENT", [0, 6, 16, 100][trial])
        monkeypatch.setattr(conversations, "CHUNK", 8)
        monkeypatch.setattr(conversations, "HOT_PARENTS", 1 if trial == 1 else 512)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("x"))
    got = conversations.prefix_trie(table.repartition(1 + 3 * trial))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rows)
    assert {t for _, t in got.dtypes} == {"bigint", "string"}


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.prefix_trie(empty).collect() == []


def test_fat_binary_search_finds_every_exit():
    """Exit depths and compacted nodes against prefixes compared one by one."""
    rng = random.Random(0)
    for _ in range(400):
        first, symbols = rng.choice([0, 3, 509]), rng.choice([1, 2, 3])
        some = [[rng.randrange(symbols) for _ in range(rng.randint(0, rng.choice([3, 10, 40])))] for _ in range(rng.randint(1, 30))]
        some += [s[: rng.randint(0, len(s))] for s in some[:5]]
        trie, known = conversations.ZFastTrie(first, ((), 0)), set()
        for n, s in enumerate(some):
            keys = [(tuple(s[:d]), d) for d in range(len(s) + 1)]
            shared = max((d for d in range(len(s) + 1) if any(q[:d] == tuple(s[:d]) and len(q) >= d for q in known)), default=0)
            assert trie.exit(keys)[1] == first + shared
            assert trie.path[trie.insert(keys, n)][len(s)] == keys[-1]
            known.add(tuple(s))
        nodes = {()} | known
        for s in known:
            nodes |= {s[:d] for d in range(len(s)) if len({q[d] for q in known if len(q) > d and q[:d] == s[:d]}) > 1}
        assert {trie.path[i][trie.end[i] - first][0] for i in range(len(trie.low))} == nodes and len(trie.low) == len(nodes)


# Search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_search(docs, items, k):
    words = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n_docs, n_terms = sum(map(bool, words)), sum(map(len, words))
    df = collections.Counter(w for some in words for w in set(some))
    out = []
    for item, text in items:
        scored = []
        for (i, _), some in zip(docs, words):
            tf = collections.Counter(some)
            score = 0
            for w in set(TERM.findall((text or "").translate(LOWER))) & tf.keys():
                m = 100 - 50 + (50 * len(some) * n_docs) // n_terms
                weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1)))
                score += weight * ((1_000_000_000 * tf[w]) // (1000 * tf[w] + 20 * m))
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 7])
def test_search_equals_plain_version(spark, k, monkeypatch):
    rng = random.Random(k)
    bits = ["ab", "AB", "é", "É", "x1", "zz", "日本", "K", "K", "q", "a_b", "a-b", "ß"]
    docs = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)]
    docs += [(400 + i, "copy of one text") for i in range(200)] + [(9, "copy of one text"), (None, "ab x1"), (-3, None), (-4, " .,"), (8000, "ab " * 200_000)]
    items = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(50, "copy TEXT"), (51, None), (52, "absent")]
    monkeypatch.setattr(lexical, "DOCS", 32)
    monkeypatch.setattr(lexical, "ITEMS", 7)
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(6)
    asked = spark.createDataFrame([*items, (None, "ab")], "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = plain_search(docs, items, k)
    assert sorted(map(tuple, lexical.search(table, asked, k).collect())) == want
    monkeypatch.setattr(lexical, "WAVE_ITEMS", 9)  # several waves of items, products split into many columns
    monkeypatch.setattr(lexical, "EXACT", 1 << 33)
    assert sorted(map(tuple, lexical.search(table, asked, k).collect())) == want
    assert lexical.search(table.where("false"), asked, k).collect() == []
    assert lexical.search(table, asked.where("false"), k).collect() == []


def test_repeated_item_ids_ask_once(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "bb")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(5, "bb"), (5, "aa")], "item_id bigint, text string")
    assert [(r["item_id"], r["doc_id"]) for r in lexical.search(docs, asked).collect()] == [(5, 1)]
