"""Document quality: random Fourier features, ridge by normal equations, isotonic calibration.

Statistics of whole texts are mapped to cosines of random projections, whose inner products approximate a
Gaussian kernel.  Each partition sums its part of the normal equations; the driver adds and solves a system
of fixed size.  Scores of rows kept out of the fit are counted in fixed bins and made monotone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .scan import id_and_text, over_texts, scan_texts

MAX_TRAIN = 200_000  # labelled rows used; the only bound of the fit
COSINES = 256
SCALE = 0.35  # of the random projections: the kernel's inverse width on standardised statistics
RIDGE = 1e-3
BINS = 1024  # of raw scores in [-1, 2] for the calibration
PARTS = 16  # partitions of the bounded training rows
BLEND = 0.02  # share of the raw score in the calibrated one, so that steps keep their order

# Byte classes: 1 upper, 2 lower, 3 digit, 4 sentence marks, 5 other marks, 6 blanks, 7 line ends, 0 the rest.
_CLASS = np.zeros(256, dtype=np.uint8)
for _kind, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t\x0b\x0c", b"\n\r"), 1):
    _CLASS[list(_bytes)] = _kind
STATISTICS = 18


def _sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of the slices of ``values`` between neighbouring ``firsts``; empty slices give 0."""
    totals = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return totals[firsts[1:]] - totals[firsts[:-1]]


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``STATISTICS`` numbers per text, from all of it; an empty text has zeros."""
    out = np.zeros((len(texts), STATISTICS))
    for at, data, starts, ends, names, firsts in scan_texts(texts):
        n = len(firsts) - 1
        sizes = np.array([len(t) for t in texts[at : at + n]], dtype=np.int64)
        doc = np.repeat(np.arange(n), sizes + 1)
        kinds = np.bincount(doc * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8).astype(float)
        kinds[:, 7] -= 1  # the line end that closes the text
        words = np.diff(firsts).astype(float)
        per_word = np.maximum(words, 1)
        length = (ends - starts).astype(float)
        word_doc = np.repeat(np.arange(n), np.diff(firsts))
        same = np.zeros(len(names))
        same[1:] = (names[1:] == names[:-1]) & (word_doc[1:] == word_doc[:-1])
        key = names ^ (word_doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[order][1:] != key[order][:-1]
        distinct = np.bincount(word_doc[order[new]], minlength=n)
        first, last = _CLASS[data[starts]], _CLASS[data[ends - 1]]
        mean = _sums(length, firsts) / per_word
        size = np.maximum(sizes, 1)
        rows = out[at : at + n]
        rows[:, :8] = kinds / size[:, None]
        rows[:, 8] = np.log1p(words)
        rows[:, 9] = mean
        rows[:, 10] = np.sqrt(np.maximum(0, _sums(length**2, firsts) / per_word - mean**2))
        rows[:, 11] = _sums(same, firsts) / per_word
        rows[:, 12] = distinct / per_word
        rows[:, 13] = _sums(length == 1, firsts) / per_word
        rows[:, 14] = _sums(last == 5, firsts) / per_word
        rows[:, 15] = _sums(first == 1, firsts) / per_word
        rows[:, 16] = np.log1p(sizes / (np.maximum(kinds[:, 7], 0) + 1))
        rows[:, 17] = _sums(length <= 3, firsts) / per_word
        rows[sizes == 0] = 0
    return out


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make(texts: list[bytes]) -> dict:
        flat = pa.array(statistics(texts).astype(np.float32).ravel())
        return {"x": pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * STATISTICS), flat)}

    return over_texts(id_and_text(docs, id_col, text_col), make, "doc_id bigint, x array<float>")


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, y`` (0 or 1): the majority of a document's labels, ties 1; null ids and labels take no part."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    return known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.when(F.avg(column) >= 0.5, 1.0).otherwise(0.0).alias("y")
    )


def bounded_sample(labelled: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of their ids as ``_h``; a larger table is first cut at the
    hash below which about so many lie, so that the sort sees few rows."""
    rows = labelled.withColumn("_h", F.xxhash64("doc_id"))
    n = labelled.count()
    if n > most:
        share = min(1.0, (most + 6 * math.sqrt(most) + 100) / n)
        rows = rows.where(F.col("_h") <= int(share * (1 << 64)) - (1 << 63) - 1)
    return rows.orderBy("_h", "doc_id").limit(most)


def remainder(of: int):
    """crc32 of the id as text, modulo ``of``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


class Model:
    """Standardisation, random projections, ridge weights and the calibration's steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(0, SCALE, (STATISTICS, COSINES))
        self.b = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.steps_x, self.steps_y = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        cosines = np.sqrt(2 / COSINES) * np.cos(z @ self.w + self.b)
        return np.hstack([cosines, np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -1, 2)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return (1 - BLEND) * np.interp(raw, self.steps_x, self.steps_y) + BLEND * (raw + 1) / 3


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, STATISTICS)


def _isotonic(ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: centres and shares of the pooled blocks."""
    blocks: list[list[float]] = []  # rows, ones, sum of centres
    for i in np.flatnonzero(rows):
        blocks.append([rows[i], ones[i], rows[i] * (-1 + 3 * (i + 0.5) / BINS)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([c / n for n, _, c in blocks]), np.array([k / n for n, k, _ in blocks])


def fit(stats: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """A model from statistics and ``doc_id, y``.  Up to ``max_train`` labelled rows, chosen by hash, are used: four
    fifths for the fit and the rest for the calibration.  Without rows of both kinds every score is near their share."""
    chosen = bounded_sample(labelled, max_train)
    train = stage(
        stats.join(chosen, "doc_id").select("x", "y", (F.pmod("_h", F.lit(5)) != 0).alias("fit")).coalesce(PARTS), "train"
    )
    xs = [F.col("x")[i].cast("double") for i in range(STATISTICS)]
    facts = train.agg(F.avg("y").alias("y"), *[F.avg(x) for x in xs], *[F.stddev_pop(x) for x in xs]).first()
    if facts["y"] is None:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS))
    model = Model(np.array(facts[1 : 1 + STATISTICS]), np.array(facts[1 + STATISTICS :]))

    def equations(batches):
        a, b = np.zeros((COSINES + 1, COSINES + 1)), np.zeros(COSINES + 1)
        for batch in batches:
            z = model.features(_rows(batch))
            a += z.T @ z
            b += z.T @ batch.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    a, b = np.zeros((COSINES + 1, COSINES + 1)), np.zeros(COSINES + 1)
    for r in train.where("fit").select("x", "y").mapInArrow(equations, "a binary, b binary").toLocalIterator():
        a += np.frombuffer(r["a"]).reshape(a.shape)
        b += np.frombuffer(r["b"])
    model.weights = np.linalg.solve(a + RIDGE * max(1.0, a[-1, -1] / COSINES) * np.eye(len(b)), b)

    def binned(batches):
        rows, ones = np.zeros(BINS, dtype=np.int64), np.zeros(BINS)
        for batch in batches:
            bins = np.minimum(((model.raw(_rows(batch)) + 1) / 3 * BINS).astype(int), BINS - 1)
            rows += np.bincount(bins, minlength=BINS)
            ones += np.bincount(bins, batch.column("y").to_numpy(), BINS)
        at = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(rows[at]), pa.array(ones[at])], ["bin", "rows", "ones"])

    counted = train.where("not fit").select("x", "y").mapInArrow(binned, "bin bigint, rows bigint, ones double")
    rows, ones = np.zeros(BINS), np.zeros(BINS)
    for r in counted.groupBy("bin").agg(F.sum("rows").alias("rows"), F.sum("ones").alias("ones")).collect():
        rows[r["bin"]], ones[r["bin"]] = r["rows"], r["ones"]
    if rows.any():
        model.steps_x, model.steps_y = _isotonic(ones, rows)
    else:
        model.steps_y = np.array([float(facts["y"])])
    return model


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Labels of documents whose id has crc32 remainder ``held`` modulo ``folds`` are not learned from.  Only the text
    enters a score: null and empty texts have the statistics of an empty text, and equal texts equal scores.
    Repeated rows stay.  A null id is not held out.  An empty table gives no rows; without labels scores are near 0.5.
    """
    stats = stage(text_statistics(docs), "statistics")
    model = fit(stats, one_label(labels, label).where(remainder(folds) != held))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_rows(batch)))], ["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(folds) == held, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
