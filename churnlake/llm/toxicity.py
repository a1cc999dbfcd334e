"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the distinct hashes of its words, neighbouring pairs and pairs with one word between,
lower-cased in ASCII and without marks at the ends.  Features are made in parallel; a bounded labelled sample of
them then streams through one learner in the order of its rows' hashes, whatever files they come from, with a learning
rate per coordinate and L1 sparsity, so that only features seen in many documents keep a weight: a short list that goes
to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .quality import bounded_sample, one_label, remainder
from .scan import hash_spans, id_and_text, mixed, over_texts, scan_texts

MAX_TRAIN = 50_000  # labelled documents used; the only bound of the fit
BITS = 22
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1

_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PAIR, _SKIP, _NEXT = (np.uint64(v) for v in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63))


def _grams(texts: list[bytes]):
    """Per group of texts: the first one's number, and hashed features with the text each belongs to, not distinct."""
    for at, data, starts, ends, _, firsts in scan_texts([t.lower() for t in texts]):
        starts, ends = starts.copy(), ends.copy()
        for _ in range(3):
            ends -= (ends > starts) & ~_ALNUM[data[np.maximum(ends - 1, 0)]]
            starts += (ends > starts) & ~_ALNUM[data[starts]]
        h = hash_spans(data, starts, np.maximum(starts, ends))
        doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        one, two = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
        pair = mixed(h[:-1][one] * _PAIR + h[1:][one] * _NEXT)
        skip = mixed(h[:-2][two] * _SKIP + h[2:][two] * _NEXT)
        shift = np.uint64(64 - BITS)
        yield at, len(firsts) - 1, np.concatenate([h, pair, skip]) >> shift, np.concatenate([doc, doc[1:][one], doc[2:][two]])


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def hashed_features(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct features of each text, ascending."""
    out: list[np.ndarray] = []
    for _, n, idx, doc in _grams(texts):
        keys = _distinct((doc.astype(np.uint64) << np.uint64(BITS)) | idx)
        cuts = np.searchsorted(keys, np.arange(1, n, dtype=np.uint64) << np.uint64(BITS))
        out += [(k & np.uint64((1 << BITS) - 1)).astype(np.int32) for k in np.split(keys, cuts)]
    return out


class Ftrl:
    """Follow the regularised leader, proximal, on sparse binary features."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit(docs: DataFrame, labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, np.ndarray]:
    """Features and their weights, ascending; feature ``2 ** BITS`` is the intercept.

    ``labelled`` (``doc_id, y``) is cut to ``max_train`` rows by hash, which bounds the broadcast that selects their
    texts and the learner's time; its memory is one Arrow batch and the ``2 ** BITS`` coordinates.  The learner meets the
    rows of each epoch in the order of a hash of id and features; rows equal in both are the same to it.
    """
    chosen = bounded_sample(labelled, max_train).select("doc_id", "y")
    texts = id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")

    def make(batch: list[bytes]) -> dict:
        return {"idx": pa.array(hashed_features(batch), pa.list_(pa.int32()))}

    made = over_texts(texts, make, "doc_id bigint, y double, idx array<int>", ("doc_id", "y"))
    rows = stage(made.select(F.xxhash64("doc_id", "y", "idx").alias("place"), "doc_id", "y", "idx"), "features")

    def train(batches):
        model, bias = Ftrl((1 << BITS) + 1), 1 << BITS
        for batch in batches:
            lists = batch.column("idx")
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            for y, at in zip(batch.column("y").to_pylist(), np.split(flat, ends[:-1])):
                model.learn(np.append(at, bias), y)
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["feature", "weight"])

    epochs = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))))
    ordered = epochs.repartition(1).sortWithinPartitions("epoch", "place", "doc_id").select("y", "idx")
    found = sorted(ordered.mapInArrow(train, "feature bigint, weight double").collect())
    return np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found], dtype=float)


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held: int = 1, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Labels of documents whose id has crc32 remainder ``held`` modulo ``folds`` are not learned from.  Only the text
    enters a score; null and empty texts have the intercept alone, equal texts equal scores.  Repeated rows stay.  A
    null id is not held out.  An empty table gives no rows; without labels every score is 0.5.
    """
    features, weights = fit(docs, one_label(labels, label).where(remainder(folds) != held))
    sent = docs.sparkSession.sparkContext.broadcast((features, weights))

    def make(texts: list[bytes]) -> dict:
        at, values = sent.value
        table = np.zeros((1 << BITS) + 1)
        table[at] = values
        sums = np.full(len(texts), table[-1])
        for first, n, idx, doc in _grams(texts):
            hit = np.flatnonzero(table[idx])
            keys = _distinct((doc[hit].astype(np.uint64) << np.uint64(BITS)) | idx[hit])
            of = (keys >> np.uint64(BITS)).astype(np.int64)
            sums[first : first + n] += np.bincount(of, table[keys & np.uint64((1 << BITS) - 1)], n)
        return {"score": 1 / (1 + np.exp(-np.clip(sums, -30, 30)))}

    scored = over_texts(id_and_text(docs), make, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        F.coalesce(remainder(folds) == held, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )
