"""Helpers shared by the operators: reading texts, Arrow passes and vectorised word hashing.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Its 64-bit name is a polynomial over
random byte values, taken from prefix sums of a whole buffer, so no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
LONG_WORD = 1 << 16

_RNG = np.random.default_rng(7_2024)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
OTHER_BYTE = np.random.default_rng(2_7024).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=np.int8)
_SPACE[[9, 10, 11, 12, 13, 32]] = 1
_POWERS: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns operators work on; a null text is empty.  Other columns are never looked at."""
    return docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def over_texts(
    df: DataFrame, make: Callable[[list[bytes]], dict], schema: str, keep: tuple[str, ...] = ("doc_id",), rows: int | None = None
) -> DataFrame:
    """Columns made from each batch of UTF-8 texts after the kept ones; row order and number stay.  ``rows`` cuts
    batches whose results are large."""
    names = [part.split()[0] for part in schema.split(",")][len(keep) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows or max(1, b.num_rows))):
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            columns = make(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep]
                + [columns[n] if isinstance(columns[n], pa.Array) else pa.array(columns[n]) for n in names],
                [*keep, *names],
            )

    return df.mapInArrow(run, schema)


def grouped(texts: list[bytes]) -> Iterator[list[str]]:
    """Texts in groups of about ``4 * BATCH_BYTES``, for work that pays off on many texts at once."""
    group, size = [], 0
    for t in texts:
        group.append(t.decode("utf-8", "replace"))
        size += len(t)
        if size >= 4 * BATCH_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        steps = np.full(BATCH_BYTES + LONG_WORD + 2, base, dtype=np.uint64)
        steps[0] = 1
        _POWERS[base] = np.cumprod(steps)
    return _POWERS[base]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end byte of each word of a buffer."""
    space = np.ones(len(data) + 2, dtype=np.int8)
    space[1:-1] = _SPACE[data]
    turn = np.diff(space)
    return np.flatnonzero(turn == -1), np.flatnonzero(turn == 1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """The 64-bit names of the words of a buffer, whatever buffer they stand in; other byte ``values``, other names."""
    out = np.empty(len(starts), dtype=np.uint64)
    up, down = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BATCH_BYTES, side="right")))
        if ends[at] - starts[at] <= LONG_WORD:
            first = starts[at]
            seg = data[first : ends[to - 1]]
            if len(seg) > BATCH_BYTES + LONG_WORD:
                to, seg = at + 1, data[first : ends[at]]
            sums = np.zeros(len(seg) + 1, dtype=np.uint64)
            np.cumsum(values[seg] * up[: len(seg)], out=sums[1:])
            s, e = starts[at:to] - first, ends[at:to] - first
            out[at:to] = (sums[e] - sums[s]) * down[s]
        else:
            to = at + 1
        at = to
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=int(values[0] ^ _BYTE[0]))
    return mixed(out)


def scan_texts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in groups of about ``BATCH_BYTES``: first text, buffer, word starts, ends, names, and per text the
    number of its first word in the group (one more entry closes the last text)."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_BYTES):
            size += len(texts[to]) + 1
            to += 1
        data = np.frombuffer(b"\n".join(texts[at:to]) + b"\n", dtype=np.uint8)
        starts, ends = word_spans(data)
        places = np.cumsum([0] + [len(t) + 1 for t in texts[at:to]])
        yield at, data, starts, ends, hash_spans(data, starts, ends), np.searchsorted(starts, places)
        at = to
