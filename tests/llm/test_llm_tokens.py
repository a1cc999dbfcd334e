"""Tokenizers against the library; trees under edits; packing."""

import collections
import random
import struct
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from churnlake.llm import bpe, edits, packing
from churnlake.llm.tokens import ByteEncoder, WordEncoder

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = "ab c'sd.\n\t 1²éſ<|>Σ́日 😀"
ODD = [
    "", "  ", "\n\n x \n", "<|endoftext|>a<|endoftext|>", "日本語 テスト ΑΣ İ ſ", "a\xa0b \u0085c \x1c d\x00", "don't I'M 'S 's",
    "²³¼ x²", "é café", "x" * 5000, "a b" * 2000, "́a", "😀 🤣!!", "\r\n \t", "'", "<|", "١٢٣ ꙮ",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(800)]


@pytest.fixture(scope="module")
def by_library():
    return Tokenizer.from_file(BYTES)


def test_byte_encoder_equals_library(texts, by_library):
    ours = ByteEncoder.get(BYTES)
    for t in texts:
        ids = by_library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == ids
        assert ours.decode(ids) == by_library.decode(ids, skip_special_tokens=False)


def test_word_encoder_equals_library(texts):
    library, ours = Tokenizer.from_file(WORDS), WordEncoder.get(WORDS)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert ours.encode(t) == struct.pack(f"<{len(ids)}I", *ids)


def test_speculation_fails_and_is_mended(by_library):
    """Some words must fail the pair check, or merging is never exercised."""
    ours, failed = ByteEncoder.get(BYTES), 0
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 14))) for _ in range(2000)]
    ids, of = ours.proposed(words)
    for k, w in enumerate(words):
        failed += ids[of == k].tolist() != ours.merged(w)
    assert failed > 100
    assert [list(x) for x in ours.encode_words(words)] == [by_library.encode(w, add_special_tokens=False).ids for w in words]


def test_caches_may_be_emptied(monkeypatch, by_library):
    from churnlake.llm import tokens

    monkeypatch.setattr(tokens, "WORDS_KEPT", 5)
    text = "one two three four five six seven eight nine ten one two"
    for _ in range(2):
        assert ByteEncoder(BYTES).encode(text) == by_library.encode(text).ids
    assert WordEncoder(WORDS).encode(text) == WordEncoder.get(WORDS).encode(text)


def test_tree_follows_edits(texts, by_library):
    encoder, rng, touched, whole = ByteEncoder.get(BYTES), random.Random(9), 0, 0
    for t in texts[: len(ODD) + 300]:
        tree, now = edits.CountTree(t, encoder), t
        assert tree.total == len(by_library.encode(t, add_special_tokens=False).ids)
        for _ in range(4):
            a = rng.randint(0, len(now))
            b = min(len(now), a + rng.choice([0, 1, 3, 50]))
            put = rng.choice(["", "a", " ", "\n", " the cat's", "<|endoftext|>", "xyz " * 30])
            now = now[:a] + put + now[b:]
            tree.edit(a, b, put)
            assert tree.text == now
            assert tree.total == len(by_library.encode(now, add_special_tokens=False).ids)
            if tree.blocks:
                assert tree.levels[-1][0, 0] == len(now)
    text = "some plain words, " * 3000
    tree = edits.CountTree(text, encoder)
    tree.edit(20_000, 20_003, "changed")
    touched, whole = tree.reencoded, len(tree.text)
    assert tree.total == len(by_library.encode(tree.text).ids)
    assert touched < whole / 200


def test_queries_over_odd_rows(spark, by_library):
    rows = [(i, t, "x") for i, t in enumerate([*ODD, None, "same", "same"])] + [(None, "no id", "x"), (3, ODD[3], "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    want = collections.Counter()
    for i, t, _ in rows:
        ids = by_library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids)] += 1
    got = bpe.round_trip(docs, BYTES).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    encoded = bpe.encode_texts(docs, BYTES)
    back = bpe.decode_ids(encoded, BYTES).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in back) == collections.Counter((i, t or "") for i, t, _ in rows)
    counted = edits.count_under_edits(docs, BYTES).collect()
    assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in counted) == want
    empty = docs.where("false")
    for made in (bpe.round_trip(empty, BYTES), edits.count_under_edits(empty, BYTES), packing.pack(empty, WORDS)):
        assert made.collect() == []


def test_counts_after_redaction(spark, by_library):
    texts = ["call 555-123-4567 or a.b@c.de now", "nothing", "1234567890 " * 50, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in edits.count_under_edits(docs, BYTES).collect():
        text = texts[r["doc_id"]] or ""
        after = edits.PERSONAL.sub("<redacted>", text)
        assert r["n_edits"] == len(edits.PERSONAL.findall(text))
        assert r["n_tokens_after"] == len(by_library.encode(after).ids)


@pytest.mark.parametrize(
    "counts",
    [
        {}, {3: 5}, {2048: 7, 1: 1}, {1: 5000}, {1025: 10, 1023: 10}, {700: 30, 1300: 20, 48: 100},
        dict(collections.Counter(random.Random(1).randint(1, 2048) for _ in range(500))),
        dict(collections.Counter(int(random.Random(i).lognormvariate(6, 1)) % 2048 + 1 for i in range(20_000))),
    ],
)
def test_bins_hold_all_pieces(counts):
    used, bins = collections.Counter(), 0
    for lengths, times in packing.complete_bins(counts):
        assert sum(lengths) <= 2048 and times > 0
        bins += times
        for s in lengths:
            used[s] += times
    assert used == counts
    assert bins <= sum(n for _, n in packing.best_fit_decreasing(counts, 2048))
    assert bins >= -(-sum(s * n for s, n in counts.items()) // 2048)


def test_search_beats_best_fit():
    """Best-fit decreasing needs four sequences of 10 here; completion finds the three that are enough."""
    counts = {6: 1, 5: 1, 4: 2, 3: 2, 2: 2, 1: 1}
    assert sum(n for _, n in packing.complete_bins(counts, 10)) == 3


def test_packing_places_every_token(spark):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "on"]) for _ in range(rng.choice([3, 200, 900, 2500, 5000]))) for _ in range(60)]
    texts += [None, "", "same words", "same words"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, length int")
    rows = packing.pack(docs.repartition(3), WORDS, with_ids=True).collect()
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = r["ids"]
        assert len(ids) == r["length"] and zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], ids))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t in enumerate(texts):
        want, got = library.encode(t or "", add_special_tokens=False).ids + [0], sorted(pieces[i])
        assert [p for p, _, _ in got] == list(range(len(got)))
        assert [x for _, _, ids in got for x in ids] == want
        assert all(s == 2048 * p for p, s, _ in got)
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // 2048) + 2
