"""Top-k, personal data, classifiers and the pipeline."""

import math
import random
import zlib

import corpus_pipeline
import llm_brute as brute
import pytest
from pyspark.sql import functions as F

from churnlake.llm import catalog, pii, quality, topk, toxicity
from churnlake.llm.scan import read_table

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("k", [1, 5])
def test_top_k(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-0.5, 0.25, 1.0, 0.1]) for _ in range(4)], "x") for i in range(400)]
    rows += [(400 + i, [0.5] * 4, "x") for i in range(300)]  # many ties
    rows += [(1000, None, "x"), (1050, [None, 1.0, 1.0, 1.0], "x"), (1100, [math.nan, 1.0, 1.0, 1.0], "x"), (1150, [math.inf] * 4, "x")]
    rows += [(1200, [], "x"), (1250, [0.3, 0.2], "x"), (1251, [0.9, -0.2], "x"), (None, [9.0] * 4, "x"), (1300, [1e5] * 4, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string").repartition(4)
    clean = {}
    for r in df.collect():
        v = r["embedding"]
        if r["vec_id"] is not None and v is not None and all(c is not None and math.isfinite(c) for c in v):
            clean[r["vec_id"]] = [math.floor(256 * c) for c in v]
    want = set()
    for q, a in clean.items():
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in clean.items() if c != q and len(a) == len(b))
            want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scored[:k])}
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k).collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def test_top_k_in_waves_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "WAVE", 7)
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    few = topk.top_k(table, F.col("vec_id") % 25 == 0, 3)
    monkeypatch.undo()
    one = topk.top_k(table, F.col("vec_id") % 25 == 0, 3)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))
    assert topk.top_k(table.where("false"), F.lit(True)).collect() == []


def test_personal_data(spark):
    rng = random.Random(4)
    bits = [
        "a@b.co", "x_y@z-1.com.de", ".", "@", "+1 (523) 555-1055", "+", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111 1111 1111",
        " ", "-", "é", "😀", "12", "0.0.0.0.1", "a.b@c", "@d.e", "555-123-4567", "sk_live_9a8B7c6D5e4F3g2H1i0J", "\n", "007.1.1.1", "call ",
    ]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["1." * 3000, "a@b" + ".c" * 3000, "9" * 20_000, "12 " * 1500, "a" * 20_000, "", "a@b.co " * 700]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(-1, None, "x"), (None, "a@b.co", "x"), (0, texts[0], "x")]
    got = pii.personal_data(spark.createDataFrame(rows, "doc_id bigint, text string, spans string")).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, t, _ in rows:
        counts, line = brute.personal(t or "")
        r = by_id[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == counts
        assert r["base_sha256"] == brute.sha(line)
        assert set(filter(None, line.split(","))) <= set(r["spans"].split(","))


def test_added_spans_and_redaction(spark):
    token = "ab8ca1b325bc4f85aa6a79e73fc4cbfc2098878e"
    rows = [(i, f"mail a{i}@example.com or call +1 (523) 555-10{i:02d}, server 9.8.7.{i}") for i in range(60)]
    rows += [(100 + i, f'my token = "{token}" and phone 555-123-45{i:02d}') for i in range(30)]
    rows += [(200, "internationalization_of_everything and nothing else"), (201, None), (202, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.personal_data(docs).collect()}
    assert found[100] == f"phone:{rows[60][1].index('555')}:{len(rows[60][1])},secret:12:52"
    assert found[200] == found[201] == found[202] == ""
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text[0] == "mail <email> or call <phone>, server <ip>"
    assert text[100] == 'my token = "<secret>" and phone <phone>'
    assert text[200] == rows[-3][1] and text[201] is None and text[202] == ""


def test_estimated_reliabilities():
    """Two good labelers and one that guesses: the estimates tell them apart."""
    rng, rows = random.Random(1), {}
    for _ in range(4000):
        y = rng.random() < 0.6
        vote = tuple(int(y if rng.random() < p else not y) for p in (0.95, 0.9, 0.5, 0.9))
        rows[vote] = rows.get(vote, 0) + 1
    beliefs, rates = pii.estimate([(list(v), [0], n) for v, n in rows.items()])
    assert rates[0][0] > 0.9 and rates[0][1] < 0.1
    assert abs(rates[2][0] - 0.5) < 0.05 and abs(rates[2][1] - 0.5) < 0.05


def test_personal_data_is_native(spark):
    docs = read_table(spark, "/root/testdata/sf0.001", "documents")
    text = pii.found_spans(docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r for r in read_table(spark, "/root/testdata/sf0.1", "labels").collect()}


@pytest.mark.parametrize(
    "make, column, folds, held, least",
    [(quality.score, "quality", 4, 2, 0.98), (toxicity.score, "toxic", 3, 1, 0.95)],
)
def test_classifier_on_held_out_labels(spark, labels, make, column, folds, held, least):
    docs, table = (read_table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    rows = make(docs, table).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == held)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    truth = [labels[r["doc_id"]][column] for r in test]
    assert brute.auc([r["score"] for r in test], truth) > least
    picked = [y for r, y in zip(test, truth) if r["predicted"]]
    assert sum(picked) / len(picked) > 0.98


def test_toxicity_does_not_depend_on_files_and_equals_a_plain_learner(spark):
    """The same rows in one, three or seven partitions give equal scores, those of a learner written out plainly."""
    docs = read_table(spark, DATA, "documents").select("doc_id", "text").cache()
    labels = read_table(spark, DATA, "labels")
    scores = [
        {r["doc_id"]: r["score"] for r in toxicity.score(docs.repartition(n, F.hash("text")), labels.repartition(n)).collect()}
        for n in (1, 3, 7)
    ]
    assert scores[0] == scores[1] == scores[2]
    given = {r["doc_id"]: float(r["toxic"]) for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    features = dict(zip(texts, toxicity.hashed_features(list(texts.values()))))
    learned = [(i, y, features[i].tolist()) for i, y in given.items() if i in texts]
    rows = spark.createDataFrame(learned, "doc_id bigint, y double, idx array<int>")
    order = [(r["y"], r["idx"]) for r in rows.orderBy(F.xxhash64("doc_id", "y", "idx")).collect()]
    z, n = {}, {}

    def weight(f):
        if abs(z.get(f, 0.0)) <= toxicity.L1:
            return 0.0
        rate = (toxicity.BETA + math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA + toxicity.L2
        return (math.copysign(toxicity.L1, z[f]) - z[f]) / rate

    def margin(idx):
        return max(-30.0, min(30.0, sum(weight(f) for f in [*idx, -1])))

    for y, idx in order * toxicity.EPOCHS:
        g = 1 / (1 + math.exp(-margin(idx))) - y
        for f, w in [(f, weight(f)) for f in [*idx, -1]]:
            z[f] = z.get(f, 0.0) + g - (math.sqrt(n.get(f, 0.0) + g * g) - math.sqrt(n.get(f, 0.0))) / toxicity.ALPHA * w
            n[f] = n.get(f, 0.0) + g * g
    for i in list(texts)[::7]:
        assert scores[0][i] == pytest.approx(1 / (1 + math.exp(-margin(features[i].tolist()))), abs=1e-6)


@pytest.mark.parametrize("make, column", [(quality.score, "quality"), (toxicity.score, "toxic")])
def test_classifier_on_odd_rows(spark, make, column):
    rows = [(i, f"some text {i % 7} of words", "x") for i in range(80)] + [(900, None, "x"), (901, "", "x"), (None, "text", "x"), (3, "again", "x")]
    rows += [(902, "word " * 50_000, "x"), (903, "x" * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    marks = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)] + [(1, None, 0), (None, 1, 1), (2, 1, 1), (999, 0, 0)], "doc_id bigint, quality int, toxic int")
    for given in (marks, marks.where("false"), marks.where(f"{column} = 1")):
        got = make(docs, given).collect()
        assert len(got) == len(rows)
        assert all(0 <= r["score"] <= 1 for r in got)
        same = {r["score"] for r in got if r["doc_id"] in (900, 901)}
        assert len(same) == 1
    assert make(docs.where("false"), marks).collect() == []


def test_bounded_sample(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "1.0 as y")
    some = {r["doc_id"] for r in quality.bounded_sample(rows, 700).collect()}
    assert len(some) == 700
    assert some == {r["doc_id"] for r in rows.orderBy(F.xxhash64("doc_id")).limit(700).collect()}
    assert quality.bounded_sample(rows, 6000).count() == 5000


def test_labels_of_the_held_fold_are_not_used(spark):
    docs, table = (read_table(spark, DATA, n) for n in ("documents", "labels"))
    turned = table.withColumn("quality", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality.score(docs, t).collect())) for t in (table, turned))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert all(abs(a[2] - b[2]) < 1e-6 for a, b in zip(one, two))


def test_pipeline_against_plain_versions(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = read_table(spark, sf_dir, "documents")
    columns = docs.columns
    for (name, apply), check in zip(corpus_pipeline.STAGES, (None, "exact", "near", "pii", "pack")):
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = corpus_pipeline.stage(apply(spark, docs, sf_dir), "test-stage")
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        texts = [(i, r["text"]) for i, r in before.items()]
        if check == "pack":
            assert set(after) == set(before)
            break
        assert docs.columns == columns and len(after) == len(rows)
        if check == "exact":
            assert set(after) == {i for i, _, _, kept, _ in brute.exact(texts) if kept}
        elif check == "near":
            assert set(after) == {i for i, (_, _, kept) in brute.near(texts, 5, 80).items() if kept}
        elif check == "pii":
            assert set(after) == set(before)
            for i, t in texts:
                found = brute.personal(t)[1]
                assert not any(brute.personal(after[i]["text"])[0])
                if not found and "<" not in after[i]["text"]:
                    assert after[i]["text"] == t
                assert after[i]["n_chars"] == len(after[i]["text"])


def test_pipeline_keeps_good_documents(spark):
    docs, table = (read_table(spark, DATA, n) for n in ("documents", "labels"))
    labels = {r["doc_id"]: r["quality"] for r in table.collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, DATA).collect()}
    good, bad = ({i for i, q in labels.items() if q == v} for v in (1, 0))
    assert len(good & kept) >= 0.98 * len(good)
    assert len(bad & kept) <= 0.1 * len(bad)


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(catalog.ORACLES) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    from compare import compare, connect

    assert compare(spark, connect(DATA), DATA, catalog.QUERIES[name], catalog.ORACLES[name]) == ""
