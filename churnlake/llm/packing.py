"""Best-fit packing of documents into sequences by bin completion on the histogram of piece lengths.

Pieces of one length are interchangeable, so the search sees only how many pieces of each of the ``capacity``
lengths there are: a table whose size doesn't grow with the input.  It takes the largest length left,
enumerates fillings of the room beside it that no other filling dominates, and branches over them, pruning by
the waste that the best known packing allows; best-fit decreasing gives the first incumbent.  The packing is
a list of patterns with repeat counts, which a range join turns into places for all pieces.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage
from .scan import id_and_text
from .tokens import WordEncoder

CAPACITY = 2048
NODES = 1200  # search nodes for the fillings around one document
WIDTH = 4  # fillings kept to branch over
DIVES = 8  # packings tried

Pattern = tuple[tuple[int, ...], int]


def cut_pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``): each document's ids, then ``end_id``, cut every
    ``capacity`` ids.  A null or empty text is the end id alone."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
    names = [c.split()[0] for c in schema.split(", ")]
    end, step = end_id.to_bytes(4, "little"), 4 * capacity

    def run(batches):
        import numpy as np

        encoder = WordEncoder.get(path)
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                ids = encoder.encode(raw.decode("utf-8", "replace")) + end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    row = [doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)]
                    for values, value in zip(rows, [*row, np.frombuffer(part, "<u4").astype("i4")] if with_ids else row):
                        values.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds)], names)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Packing that puts each length, largest first, into the fullest open sequences it fits; equal ones at once."""
    open_bins: dict[int, list[list]] = {capacity: []}  # room left: [[lengths, how many sequences]]
    for size in sorted(counts, reverse=True):
        left, rooms, at = counts[size], sorted(r for r in open_bins if open_bins[r]), 0
        rooms = rooms[bisect_left(rooms, size) :]
        while left:
            while at < len(rooms) and not open_bins[rooms[at]]:
                at += 1
            if at < len(rooms):
                room, (lengths, n) = rooms[at], open_bins[rooms[at]].pop()
                used = min(n, left)
                if n > used:
                    open_bins[room].append([lengths, n - used])
                placed = lengths + (size,)
                rest = room - size
                if rest >= size:  # these sequences can take more of this length
                    more = bisect_left(rooms, rest)
                    if more == len(rooms) or rooms[more] != rest:
                        rooms.insert(more, rest)
                        at += more <= at
                    at = min(at, more)
            else:
                fit = capacity // size
                used, placed = (left // fit, (size,) * fit) if left >= fit else (1, (size,) * left)
                rest = capacity - size * len(placed)
                open_bins.setdefault(rest, []).append([placed, used])
                left -= used * len(placed)
                continue
            open_bins.setdefault(rest, []).append([placed, used])
            left -= used
    return [(tuple(p), n) for bins in open_bins.values() for p, n in bins]


def fillings(room: int, sizes: list[int], counts: dict[int, int], width: int = WIDTH, nodes: int = NODES) -> list[tuple[int, ...]]:
    """Up to ``width`` fillings of ``room`` from ``sizes`` (ascending), least waste first, none of them dominated.

    A filling is dominated if an unused length would fit in place of one or two of its members and waste less.
    """
    found: list[tuple[int, tuple[int, ...]]] = []
    left = [nodes]

    def between(low: int, high: int) -> bool:  # is there a length in (low, high]
        return bisect_right(sizes, high) > bisect_right(sizes, low)

    def dominated(chosen: list[int], waste: int) -> bool:
        if not waste:
            return False
        if any(between(c, c + waste) for c in set(chosen)):
            return True
        few = chosen[:8]
        return any(between(a + b - 1, a + b + waste) for i, a in enumerate(few) for b in few[i + 1 :])

    def visit(room: int, top: int, chosen: list[int]) -> bool:
        """Extend by lengths below ``sizes[top]``; true ends the search."""
        left[0] -= 1
        usable = min(top, bisect_right(sizes, room))
        if not usable:
            spare = any(counts[s] > chosen.count(s) for s in sizes[: min(8, bisect_right(sizes, room))])
            if not spare and not dominated(chosen, room):
                found.append((room, tuple(chosen)))
                found.sort(key=lambda f: f[0])
                del found[width:]
            return len(found) == width and found[-1][0] == 0
        for j in range(usable - 1, -1, -1):
            size = sizes[j]
            for k in range(min(counts[size], room // size), 0, -1):
                if visit(room - k * size, j, [*chosen, *[size] * k]) or left[0] <= 0:
                    return True
        return False

    if not sizes or sizes[0] > room:
        return [()]
    visit(room, len(sizes), [])
    return [f for _, f in found] or [_greedy(room, sizes, counts)]


def _greedy(room: int, sizes: list[int], counts: dict[int, int]) -> tuple[int, ...]:
    chosen: list[int] = []
    for size in reversed(sizes):
        n = min(counts[size], room // size)
        chosen += [size] * n
        room -= n * size
    return tuple(chosen)


def complete_bins(counts: dict[int, int], capacity: int = CAPACITY, dives: int = DIVES) -> list[Pattern]:
    """Patterns with repeat counts that use each length as often as ``counts`` says, in few sequences.

    Depth-first over the fillings of the largest length left; a dive ends when its waste exceeds what a packing
    better than the incumbent may waste, and the search when the incumbent meets the lower bound.
    """
    counts = {s: n for s, n in counts.items() if n}
    total = sum(s * n for s, n in counts.items())
    bound = max(-(-total // capacity), sum(n for s, n in counts.items() if 2 * s > capacity))
    best = best_fit_decreasing(counts, capacity)
    best_n = sum(n for _, n in best)
    pending = [(dict(counts), [], 0)]  # state, patterns so far, waste so far
    while pending and best_n > bound and dives:
        state, plan, waste = pending.pop()
        dives -= 1
        sizes = sorted(state)
        branched = 0
        while sizes and waste <= (best_n - 1) * capacity - total:
            top = sizes[-1]
            state[top] -= 1
            if not state[top]:
                del state[top]
                sizes.pop()
            options = fillings(capacity - top, sizes[: bisect_right(sizes, capacity - top)], state)
            state[top] = state.get(top, 0) + 1
            if sizes[-1:] != [top]:
                sizes.append(top)
            if len(options) > 1 and branched < 2 and len(pending) < dives:
                for other in options[1:2]:
                    branched += 1
                    pending.insert(0, _applied(dict(state), list(plan), waste, (top, *other), capacity))
            state, plan, waste = _applied(state, plan, waste, (top, *options[0]), capacity)
            sizes = [s for s in sizes if s in state]
        if not state and (n := sum(k for _, k in plan)) < best_n:
            best, best_n = plan, n
    return best


def _applied(state: dict[int, int], plan: list, waste: int, lengths: tuple[int, ...], capacity: int):
    """The state after the pattern has been used as often as the counts allow."""
    need: dict[int, int] = {}
    for s in lengths:
        need[s] = need.get(s, 0) + 1
    times = min(state[s] // k for s, k in need.items())
    for s, k in need.items():
        state[s] -= times * k
        if not state[s]:
            del state[s]
    plan.append((lengths, times))
    return state, plan, waste + times * (capacity - sum(lengths))


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces: sequences of at most ``capacity`` ids, gapless from 0.

    Only counts by length reach the driver.  Pieces are numbered within (length, slice of the staged table) and
    shifted by the sizes of earlier slices, so a common length never meets in one task.
    """
    spark = pieces.sparkSession
    staged = stage(pieces.withColumn("_slice", F.spark_partition_id()), "pieces")
    cells = stage(staged.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n")), "cells")
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots, base, used = [], 0, {}
    for lengths, times in complete_bins(counts, capacity):
        offset = 0
        ordered = sorted(lengths, reverse=True)
        for size in sorted(set(ordered), reverse=True):
            k = ordered.count(size)
            first = used.get(size, 0)
            slots.append((size, first, first + k * times, base, k, offset))
            used[size] = first + k * times
            offset += k * size
        base += times
    schema = "length bigint, _from bigint, _to bigint, _base bigint, _times int, _offset bigint"
    places = spark.createDataFrame(slots, schema)
    earlier = Window.partitionBy("length").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        staged.withColumn("_within", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_slice"])
        .withColumn("_rank", F.col("_within") + F.col("_before"))
    )
    here = (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    p = places.withColumnRenamed("length", "_length")
    return ranked.join(F.broadcast(p), (F.col("length") == F.col("_length")) & here).select(
        *pieces.columns,
        F.expr("_base + (_rank - _from) div _times").alias("sequence_id"),
        F.expr("_offset + (_rank - _from) % _times * length").alias("offset"),
    )


def pack(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of all documents with their places; see :func:`cut_pieces` and :func:`place_pieces`.

    Every row is packed: repeated rows and null ids are documents of their own; an empty table gives no rows.
    """
    return place_pieces(cut_pieces(docs, path, capacity, end_id, with_ids, id_col, text_col), capacity)
