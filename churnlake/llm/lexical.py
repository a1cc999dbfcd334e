"""Exact ranked lexical search by dense blocked matrix products.

Every document becomes one row of term counts over the vocabulary of the items (a written table; texts are read once a
wave of items).  Its statistics fix the integer weights.  A task then multiplies tiles: the weights of up to ``ITEMS``
items over the terms that a block of documents holds, times the impacts of these terms in the block.  The products run
in float64, and columns are split so that no partial sum reaches 2^53, so every score is an exact integer.  A task keeps
each item's best ``k`` with ties by id; only these leave it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .scan import BATCH_BYTES, hash_spans, id_and_text, over_texts

WAVE_ITEMS, WAVE_BYTES = 4096, 16 << 20  # what is broadcast at once: items and bytes of their texts
ITEMS, DOCS = 256, 512  # a tile
EXACT = 1 << 53
MOST_IMPACT = 1_000_000  # no impact reaches more: 10^9 tf div (1000 tf + 20 m) <= 10^6
SALTS = 64

_BYTES = np.arange(256)
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_IN_TERM = (
    ((_BYTES >= 48) & (_BYTES <= 57)) | ((_BYTES >= 97) & (_BYTES <= 122)) | ((_BYTES >= 65) & (_BYTES <= 90)) | (_BYTES >= 128)
)


def terms(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``BATCH_BYTES``: first and last text, names of all terms, first term of each text.

    A term is a maximal run of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.  Its name is
    a 64-bit hash of its bytes.
    """
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES):
            size += len(texts[to]) + 1
            to += 1
        data = _LOWER[np.frombuffer(b"\n".join(texts[at:to]) + b"\n", dtype=np.uint8)]
        turn = np.diff(np.concatenate([[0], _IN_TERM[data].view(np.int8), [0]]))
        starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        places = np.cumsum([0] + [len(t) + 1 for t in texts[at:to]])
        yield at, to, hash_spans(data, starts, ends), np.searchsorted(starts, places)
        at = to


class _Wave:
    """Items of one wave: the sorted names of their terms, and for each item the numbers of its distinct terms."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids = np.array(ids, dtype=np.int64)
        found = []
        for at, to, names, first in terms(texts):
            found += [np.unique(names[first[i] : first[i + 1]]) for i in range(to - at)]
        self.names = np.unique(np.concatenate(found)) if found else np.empty(0, dtype=np.uint64)
        self.terms = [np.searchsorted(self.names, f) for f in found]
        self.weights = np.zeros(len(self.names), dtype=np.int64)
        self.n_docs = self.n_terms = 0

    def weigh(self, n_docs: int, n_terms: int, df: np.ndarray) -> None:
        self.n_docs, self.n_terms = n_docs, n_terms
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)


def postings(docs: DataFrame, names: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, terms, tfs``: all terms of each whole text counted, and its terms among the named ones."""
    rows = id_and_text(docs, id_col, text_col)
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def make(texts: list[bytes]) -> dict:
        known = shared.value
        total, sizes, flat, counts = [], [], [], []
        for at, to, found, first in terms(texts):
            total.append(np.diff(first))
            place = np.searchsorted(known, found)
            hit = place < len(known)
            hit[hit] = known[place[hit]] == found[hit]
            text = np.repeat(np.arange(to - at), np.diff(first))[hit]
            pair, tf = np.unique(text * max(1, len(known)) + place[hit], return_counts=True)
            text, term = np.divmod(pair, max(1, len(known)))
            sizes.append(np.bincount(text, minlength=to - at))
            flat.append(term)
            counts.append(tf)
        none = [np.empty(0, dtype=np.int64)]
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes or none))]).astype(np.int32)

        def lists(values: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values or none).astype(np.int32)))

        return {"n": pa.array(np.concatenate(total or none).astype(np.int64)), "terms": lists(flat), "tfs": lists(counts)}

    return over_texts(rows, make, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _document_counts(rows: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the wave; a task sends on one row per term that it met."""

    def run(batches):
        held = np.zeros(size, dtype=np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
        met = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(held[met])], ["term", "df"])

    out = np.zeros(size, dtype=np.int64)
    found = rows.select("terms").mapInArrow(run, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    for r in found.toLocalIterator():  # at most one row per term of the wave
        out[r["term"]] = r["df"]
    return out


def _length_parts(n: np.ndarray, wave: _Wave) -> np.ndarray:
    """The length term m of each document."""
    if int(n.max(initial=0)) * 50 * wave.n_docs < 1 << 63:
        return 50 + (50 * n * wave.n_docs) // max(1, wave.n_terms)
    return np.array([50 + 50 * int(x) * wave.n_docs // wave.n_terms for x in n], dtype=np.int64)


def tile_scores(weights: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Exact integer products of whole numbers held in float64; columns are split so that partial sums stay below 2^53."""
    most = int(weights.max(initial=0)) * MOST_IMPACT
    step = max(1, (EXACT - 1) // most) if most else max(1, weights.shape[1])
    out = np.zeros((weights.shape[0], impacts.shape[1]), dtype=np.int64)
    for i in range(0, weights.shape[1], step):
        out += (weights[:, i : i + step] @ impacts[i : i + step]).astype(np.int64)
    return out


class _Best:
    """The ``k`` best documents of each item so far: higher score first, then smaller id."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.least = np.ones(items, dtype=np.int64)  # a lower score can't be among the best any more
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[first : first + len(scores), None])
        if len(item):
            self.parts.append((item + first, scores[item, doc], ids[doc]))
            self.size += len(item)
        if self.size > 4 * self.k * self.items:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        item, score, ids = (np.concatenate(p) for p in zip(*self.parts)) if self.parts else [np.empty(0, dtype=np.int64)] * 3
        order = np.lexsort((ids, -score, item))
        item, score, ids = item[order], score[order], ids[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.least[item[full]] = score[full]
        kept = place < self.k
        self.parts, self.size = [(item[kept], score[kept], ids[kept])], int(kept.sum())
        return self.parts[0]


def _search(rows: DataFrame, wave: _Wave, k: int) -> DataFrame:
    """``item_id, doc_id, score``: each task's best documents per item."""
    shared = rows.sparkSession.sparkContext.broadcast(wave)

    def run(batches):
        w = shared.value
        best = _Best(len(w.ids), k)
        tiles = []
        for i in range(0, len(w.ids), ITEMS):
            some = w.terms[i : i + ITEMS]
            tiles.append((i, np.repeat(np.arange(len(some)), [len(t) for t in some]), np.concatenate(some)))
        column = np.full(len(w.names), -1, dtype=np.int64)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            m = _length_parts(batch.column("n").to_numpy(zero_copy_only=False), w)
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False)
            term = batch.column("terms").flatten().to_numpy(zero_copy_only=False)
            tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            doc = np.repeat(np.arange(len(ids)), sizes)
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
            for a in range(0, len(ids), DOCS):
                b = min(a + DOCS, len(ids))
                part = slice(ends[a], ends[b])
                present = np.unique(term[part])
                if not len(present):
                    continue
                column[present] = np.arange(len(present))
                block = np.zeros((len(present), b - a))
                block[column[term[part]], doc[part] - a] = impact[part]
                for first, item, wanted in tiles:
                    at = column[wanted]
                    met = at >= 0
                    used, place = np.unique(at[met], return_inverse=True)
                    weights = np.zeros((min(ITEMS, len(w.ids) - first), len(used)))
                    weights[item[met], place] = w.weights[wanted[met]]
                    best.add(first, tile_scores(weights, block[used]), ids[a:b])
                column[present] = -1
        item, score, ids = best.prune()
        yield pa.RecordBatch.from_arrays([pa.array(w.ids[item]), pa.array(ids), pa.array(score)], ["item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item_id bigint, doc_id bigint, score bigint")


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 50,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each item with a score above 0, ties to smaller ids.

    Null texts have no terms.  Documents without an id count in all statistics but aren't ranked; repeated ids are
    ranked row by row.  Items without an id are left out; of repeated item ids the smallest text asks.  Empty tables and
    items without terms give no rows.  Columns beside ids and texts are never looked at.  Texts may be of any length.
    Terms are told apart by 64-bit names.
    """
    asked = id_and_text(items.where(F.col(item_col).isNotNull()), item_col, item_text).groupBy("doc_id").agg(F.min("text").alias("text"))
    asked = stage(asked, "items")
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    waves = max(1, -(-size["n"] // WAVE_ITEMS), -(-size["bytes"] // WAVE_BYTES))
    spark, paths = docs.sparkSession, []
    for i in range(waves):
        mine = asked.where(F.pmod(F.xxhash64("doc_id"), F.lit(waves)) == i).orderBy("doc_id").collect()
        wave = _Wave([r["doc_id"] for r in mine], [r["text"].encode() for r in mine])
        if not len(wave.names):
            continue
        rows = stage(postings(docs, wave.names, id_col, text_col), "postings")
        counts = rows.agg(F.count_if(F.col("n") > 0).alias("n_docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_terms")).first()
        wave.weigh(counts["n_docs"], counts["n_terms"], _document_counts(rows, len(wave.names)))
        found = _search(rows.where(F.col("doc_id").isNotNull()), wave, k)
        # A task sends k rows an item.  They shrink in salted groups first, so that no task sees those of all tasks.
        paths.append(stage(_ranked(_ranked(found, k, [F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))]).drop("rank"), k), "found"))
    if not paths:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p)
    return out.select("item_id", "rank", "doc_id", "score")


def _ranked(found: DataFrame, k: int, salt: list = ()) -> DataFrame:
    order = Window.partitionBy("item_id", *salt).orderBy(F.col("score").desc(), F.col("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
