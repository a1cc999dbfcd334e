"""Exact top-k inner products by distributed histogram selection.

Components are floor(256 x), so scores are integers.  Every pass scores all candidates against a wave of queries
in blocks.  A pass counts, per query, the scores in equal bins of the interval that holds the kth value; the
summed histograms pick the bin for the next pass, until it is one integer wide: the kth value.  A last pass
emits only scores at or above it, at most k a query and block, and ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

WAVE = 2048  # queries sent to the tasks at once: bounds what is broadcast to about WAVE vectors
BINS = 64
BLOCK = 4096  # candidates scored at once


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id, q`` (array of bigint) of the vectors without null or non-finite components, and with an id."""
    x = F.col(vec_col).cast("array<double>")
    fine = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) < F.lit(math.inf)))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("q")
    )


class _Wave:
    """The queries of one wave, by number of components, as matrices."""

    def __init__(self, rows, low, high):
        self.ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
        self.low, self.high = low, high  # inclusive interval that holds each query's kth value
        sizes = np.array([len(r["q"]) for r in rows])
        self.parts = {
            int(n): (at := np.flatnonzero(sizes == n), np.array([rows[i]["q"] for i in at], dtype=np.int64).reshape(len(at), n))
            for n in np.unique(sizes)
        }

    def scores(self, batches: Iterator[pa.RecordBatch]):
        """Blocks of ``(query numbers, candidate ids, scores, candidate is the query itself)``."""
        for batch in batches:
            column = batch.column("q")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(lengths) - lengths
            for n, (at, q) in self.parts.items():
                same = np.flatnonzero(lengths == n)
                for i in range(0, len(same), BLOCK):
                    some = same[i : i + BLOCK]
                    c = flat[starts[some][:, None] + np.arange(n)]
                    yield at, ids[some], _products(q, c), ids[some] == self.ids[at][:, None]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products; raises if one may not fit in 63 bits."""
    most = int(abs(q).max(initial=0)) * int(abs(c).max(initial=0)) * max(1, q.shape[1])
    if most < 1 << 53:
        return np.rint(q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return q @ c.T
    raise OverflowError("scores of these vectors may not fit in a long")


def _histogram(candidates: DataFrame, wave: _Wave) -> DataFrame:
    """``query, bin, n``: scores per bin of each query's interval; scores above it are in bin ``BINS``."""
    shared = candidates.sparkSession.sparkContext.broadcast(wave)

    def run(batches):
        w = shared.value
        width = (w.high - w.low) // BINS + 1
        counts = np.zeros(len(w.ids) * (BINS + 2), dtype=np.int64)
        for at, _, scores, own in w.scores(batches):
            bins = np.clip((scores - w.low[at, None]) // width[at, None], -1, BINS) + 1
            bins[scores > w.high[at, None]] = BINS + 1
            bins[own] = 0
            counts += np.bincount((at[:, None] * (BINS + 2) + bins).ravel(), minlength=len(counts))
        table = counts.reshape(len(w.ids), BINS + 2)[:, 1:]
        q, b = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype("i4")), pa.array(b.astype("i4")), pa.array(table[q, b])], ["query", "bin", "n"])

    return candidates.mapInArrow(run, "query int, bin int, n bigint").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _narrowed(wave: _Wave, hist: DataFrame, k: int) -> None:
    """Shrink each interval to the bin with the kth value; with fewer than k scores, to the lowest possible one."""
    table = np.zeros((len(wave.ids), BINS + 1), dtype=np.int64)
    for r in hist.collect():  # at most WAVE * (BINS + 1) counts
        table[r["query"], r["bin"]] = r["n"]
    from_top = np.cumsum(table[:, ::-1], axis=1)[:, ::-1]
    width = (wave.high - wave.low) // BINS + 1
    reach = from_top[:, :BINS] >= k
    chosen = np.where(reach.any(axis=1), BINS - 1 - np.argmax(reach[:, ::-1], axis=1), 0)
    enough = reach.any(axis=1)
    low = wave.low + chosen * width
    wave.high = np.where(enough, np.minimum(wave.high, low + width - 1), wave.low)
    wave.low = np.where(enough, low, wave.low)


def _winners(candidates: DataFrame, wave: _Wave, k: int) -> DataFrame:
    """``query_id, vec_id, score`` at or above the kth value: the best k of each task's rows."""
    shared = candidates.sparkSession.sparkContext.broadcast(wave)

    def run(batches):
        w = shared.value
        held = [np.empty(0, dtype=np.int64)] * 3  # query, score, id
        for at, ids, scores, own in w.scores(batches):
            q, c = np.nonzero((scores >= w.low[at, None]) & ~own)
            held = [np.concatenate(p) for p in zip(held, (at[q], scores[q, c], ids[c]))]
            if len(held[0]) > 4 * k * len(w.ids):
                held = _best(held, k)
        query, score, ids = _best(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(w.ids[query]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    return candidates.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _best(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    query, score, ids = held
    order = np.lexsort((ids, -score, query))
    first = np.searchsorted(query[order], query[order], side="left")
    order = order[np.arange(len(order)) - first < k]
    return [query[order], score[order], ids[order]]


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that fulfils ``is_query`` its ``k`` highest integer inner
    products with the other rows (all, if fewer), ties to the smaller id.

    Vectors null, with null or non-finite components, or without id take no part.  Only vectors with as many
    components as the query are candidates.  Rows with the query's own id are its own.  Of repeated query ids the
    smallest vector asks; repeated candidates count each.  Raises if scores might not fit in a long.
    """
    rows = stage(quantised(vectors, id_col, vec_col), "vectors")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    waves = max(1, -(-rows.where(is_query).count() // WAVE))
    size = F.aggregate("q", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    longest = rows.agg(F.max(size).alias("n")).first()["n"] or 0.0
    out = None
    for i in range(waves):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == i).orderBy("vec_id").collect()
        if not mine:
            continue
        reach = [math.isqrt(int(math.ceil(longest)) * max(1, sum(c * c for c in r["q"]))) + 2 for r in mine]
        most = np.array([min(r, (1 << 62) - 1) for r in reach], dtype=np.int64)
        wave = _Wave(mine, -most, most.copy())
        while (wave.high > wave.low).any():
            _narrowed(wave, _histogram(rows, wave), k)
        found = _winners(rows, wave, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.where("false").selectExpr("vec_id as query_id", "vec_id", "vec_id as score")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
