"""Repeated passages: recompression of word sequences, confirmed window by window.

Two rounds name runs and pairs of words globally, by content: a word is left or right by a bit of its name, and a
left word takes a right neighbour into a pair symbol; the second round does the same with the symbols of the first.
Whether two neighbouring words end and begin second-round symbols depends on two words on either side only, so
equal passages have equal symbol boundaries in their interior, at most four words apart.  Every window is
represented by the interior boundary whose following words have the smallest name.

1. Spark gathers the representatives' names of all documents; a name in two documents marks a possible repeat.
2. Only windows whose representative is marked are named in full and gathered; a window repeats if a document with a
   smaller id has its name.
3. The words of repeated windows leave their documents.

Names travel packed: a task sorts out what repeats among its own documents and sends each name on once, as arrays
dealt by name into buckets of bounded size, so a passage in a third of all documents is no larger than another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import broadcast_if_small, small_side
from ..session import stage
from .scan import id_and_text, mixed, over_texts, scan_texts, word_spans

BUCKET = 1_500_000  # names in a bucket, about
GROUP_BYTES = 12 << 20  # of texts whose names a task sorts at once
KEY_WORDS = 5  # named after a boundary
MARGIN = 2  # words before and after a boundary that decide it

_RNG = np.random.default_rng(808)
_PLACE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROUND = _RNG.integers(1, 1 << 63, 4, dtype=np.uint64)
_MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def _left(names: np.ndarray, turn: int) -> np.ndarray:
    return (mixed(names ^ _ROUND[turn]) & np.uint64(1)).astype(bool)


def boundaries(names: np.ndarray) -> np.ndarray:
    """Whether a second-round symbol begins at each word of a sequence; neighbours across texts don't matter,
    because windows look at boundaries two words inside them."""
    n = len(names)
    first = np.ones(n + 2, dtype=bool)  # a first-round symbol begins here
    left = _left(names, 0)
    if n > 1:
        first[1:n] = ~(left[:-1] & ~left[1:])  # equal words, a run, are on one side and never a pair
    pair = np.zeros(n, dtype=np.uint64)
    pair[: n - 1] = mixed(names[:-1] * _PLACE[0] + names[1:] * _PLACE[1]) if n > 1 else pair[:0]
    # the symbol that begins at i, and the one that ends before i
    begins = np.where(first[1 : n + 1], names, pair)
    ends = names.copy()
    if n > 1:
        ends[1:] = np.where(first[1:n], names[1:], pair[:-1])
    second = first[:n].copy()
    if n > 1:
        merge = _left(ends[:-1], 1) & ~_left(begins[1:], 1) & (ends[:-1] != begins[1:])
        second[1:] &= ~merge
    return second


def _windows(names: np.ndarray, length: int) -> np.ndarray:
    """The name of each run of ``length`` words; the last ones of the buffer, which are shorter, mean nothing."""
    sums = np.zeros(len(names), dtype=np.uint64)
    for j in range(min(length, len(names))):
        sums[: len(names) - j] += names[j:] * _PLACE[j]
    return mixed(sums)


def representatives(names: np.ndarray, firsts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the boundary that represents each, and the names at all words.

    ``firsts`` says where texts begin among the words, with one more entry for the end.
    """
    n = len(names)
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(n)
    starts = np.flatnonzero(left >= window)
    keys = _windows(names, KEY_WORDS)
    value = np.where(boundaries(names), keys, _MOST)
    at = starts + MARGIN
    best = value[at] if len(at) else value[:0]
    for j in range(MARGIN + 1, window - KEY_WORDS + 1):
        here = value[starts + j]
        lower = here < best
        at, best = np.where(lower, starts + j, at), np.where(lower, here, best)
    return starts, at, keys


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words of a buffer joined by one space; the buffer has a byte after its last word."""
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return b""
    step = np.zeros(len(data) + 2, dtype=np.int8)
    step[starts] = 1
    step[ends + 1] -= 1  # a kept word may begin right there
    inside = np.cumsum(step[: len(data)], dtype=np.int8).astype(bool)
    line = data.copy()
    line[ends] = 32
    return line[inside].tobytes()[:-1]


class _Packed:
    """Collects ``(name, document, place)`` of a task's texts and packs them into rows by bucket.

    A place is the number of a word; its upper half tells apart the texts of an id that has several.
    """

    SCHEMA = "bucket int, names binary, docs binary, places binary"

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, names: np.ndarray, docs: np.ndarray, places: np.ndarray, size: int) -> None:
        self.parts.append((names, docs, places))
        self.size += size

    def sorted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Names, documents, places in this order, and the number of the first row with each row's name."""
        names, docs, places = (np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.size = [], 0
        order = np.lexsort((places, docs, names))
        names, docs, places = names[order], docs[order], places[order]
        new = np.ones(len(names), dtype=bool)
        new[1:] = names[1:] != names[:-1]
        return names, docs, places, np.flatnonzero(new)[np.cumsum(new) - 1]

    def rows(self, names: np.ndarray, docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        """Sorted entries as one row a bucket: a bucket is a range of names."""
        edges = np.array([(b << 64) // self.buckets for b in range(1, self.buckets)], dtype=np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(names, edges), [len(names)]])
        full = np.flatnonzero(np.diff(cuts))
        columns = [[c[cuts[b] : cuts[b + 1]].tobytes() for b in full] for c in (names, docs, places.astype("<i8"))]
        return pa.RecordBatch.from_arrays(
            [pa.array(full.astype("i4")), *[pa.array(c, pa.binary()) for c in columns]], ["bucket", "names", "docs", "places"]
        )

    @staticmethod
    def settled(docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
        """A row without names: entries already known to repeat."""
        return pa.RecordBatch.from_arrays(
            [pa.array([-1 - int(docs[0]) % (1 << 20)], pa.int32()), pa.array([b""], pa.binary()),
             pa.array([docs.tobytes()], pa.binary()), pa.array([places.astype("<i8").tobytes()], pa.binary())],
            ["bucket", "names", "docs", "places"],
        )


def _read(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(
        np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("names", "<u8"), ("docs", "<i8"), ("places", "<i8"))
    )


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one bucket after another from batches sorted by bucket."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if rest and rest[0].column("bucket")[0].as_py() != buckets[a]:
                yield rest[0].column("bucket")[0].as_py(), pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
                rest = []
            if b > a and buckets[a] < 0:  # settled rows need not meet
                yield from ((-1, batch.slice(i, 1)) for i in range(a, b))
            elif b > a:
                rest.append(batch.slice(a, b - a))
    if rest:
        yield rest[0].column("bucket")[0].as_py(), pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


_PLACES = "doc_id bigint, kind int, place int"


def _place_rows(docs: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    kind, place = (pa.array(p.astype("i4")) for p in (places >> 32, places & 0x7FFFFFFF))
    return pa.RecordBatch.from_arrays([pa.array(docs), kind, place], ["doc_id", "kind", "place"])


def _gathered(packed: DataFrame, buckets: int, judge) -> DataFrame:
    """Places that repeat: those settled by tasks, and what ``judge(names, docs, places)`` says of each bucket."""

    def run(batches):
        for bucket, rows in _by_bucket(batches):
            names, docs, places = _read(rows)
            if bucket >= 0:
                order = np.lexsort((docs, names))
                names, docs, places = names[order], docs[order], places[order]
                repeat = judge(names, docs)
                docs, places = docs[repeat], places[repeat]
            for i in range(0, len(docs), 100_000):
                yield _place_rows(docs[i : i + 100_000], places[i : i + 100_000])

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, _PLACES)


def _first_of(names: np.ndarray) -> np.ndarray:
    new = np.ones(len(names), dtype=bool)
    new[1:] = names[1:] != names[:-1]
    return np.flatnonzero(new)[np.cumsum(new) - 1] if len(names) else np.empty(0, dtype=int)


def _in_two(names: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows (sorted by name and document) whose name is in more than one document."""
    first = _first_of(names)
    differs = docs != docs[first]
    return np.isin(first, first[differs])


def _in_smaller(names: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Rows (sorted by name and document) whose name is in a document with a smaller id."""
    return docs > docs[_first_of(names)]


def _marked(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """``doc_id, place`` of representatives whose name is in more than one document."""

    def run(batches):
        held = _Packed(buckets)

        def flush():
            names, docs, places, first = held.sorted()
            known = np.isin(first, first[docs != docs[first]])
            if known.any():
                yield held.settled(docs[known], places[known])
            # a known name goes on once, in the name of its first document, so that others learn of it
            send = ~known | (np.arange(len(first)) == first)
            yield held.rows(names[send], docs[send], places[send])

        for batch in batches:
            ids, kinds = batch.column("doc_id").to_numpy(), batch.column("kind").to_numpy().astype(np.int64) << 32
            for at, _, _, _, names, firsts in scan_texts(batch.column("text").cast(pa.binary()).to_pylist()):
                _, reps, keys = representatives(names, firsts, window)
                reps = np.unique(reps)
                doc = np.searchsorted(firsts, reps, side="right") - 1
                held.add(keys[reps], ids[at + doc], reps - firsts[doc] + kinds[at + doc], 8 * len(names))
                if held.size >= GROUP_BYTES:
                    yield from flush()
        if held.parts:
            yield from flush()

    return _gathered(texts.mapInArrow(run, _Packed.SCHEMA), buckets, _in_two)


def _repeated(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """``doc_id, place`` of windows that a smaller document has; ``texts`` has the marked ``places``."""

    def run(batches):
        held = _Packed(buckets)

        def flush():
            names, docs, places, first = held.sorted()
            known = docs > docs[first]
            if known.any():
                yield held.settled(docs[known], places[known])
            yield held.rows(names[~known], docs[~known], places[~known])

        for batch in batches:
            ids, marks = batch.column("doc_id").to_numpy(), batch.column("places")
            kinds = batch.column("kind").to_numpy().astype(np.int64) << 32
            for at, _, _, _, names, firsts in scan_texts(batch.column("text").cast(pa.binary()).to_pylist()):
                starts, reps, _ = representatives(names, firsts, window)
                some = marks.slice(at, len(firsts) - 1)
                offset = np.repeat(firsts[:-1], some.value_lengths().to_numpy())
                marked = np.zeros(len(names) + 1, dtype=bool)
                marked[some.flatten().to_numpy() + offset] = True
                starts = starts[marked[reps]]
                doc = np.searchsorted(firsts, starts, side="right") - 1
                held.add(_windows(names, window)[starts], ids[at + doc], starts - firsts[doc] + kinds[at + doc], 8 * len(names))
                if held.size >= GROUP_BYTES:
                    yield from flush()
        if held.parts:
            yield from flush()

    return _gathered(texts.mapInArrow(run, _Packed.SCHEMA), buckets, _in_smaller)


def _whole(texts: list[bytes]) -> dict:
    """Number of words and digest of the words joined by one space."""
    n, out = [], []
    for t in texts:
        data = np.frombuffer(t + b"\n", dtype=np.uint8)
        starts, ends = word_spans(data)
        n.append(len(starts))
        out.append(hashlib.sha256(joined(data, starts, ends, np.ones(len(starts), dtype=bool))).hexdigest())
    return {"n_words": pa.array(n, pa.int64()), "kept_sha256": pa.array(out, pa.string())}


def kept_words(texts: DataFrame, window: int, with_text: bool) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of texts with repeated window ``places``."""
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept_text string" * with_text

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            lists = batch.column("places")
            for i, t in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                data = np.frombuffer(t + b"\n", dtype=np.uint8)
                starts, ends = word_spans(data)
                step = np.zeros(len(starts) + 1, dtype=np.int64)
                places = lists[i].values.to_numpy()
                np.add.at(step, places, 1)
                np.add.at(step, places + window, -1)
                keep = np.cumsum(step[:-1]) == 0
                line = joined(data, starts, ends, keep)
                rows.append((len(starts), int((~keep).sum()), hashlib.sha256(line).hexdigest(), line.decode("utf-8", "replace")))
            columns = list(zip(*rows))[: 3 + with_text] if rows else [()] * (3 + with_text)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                [p.split()[0] for p in schema.split(", ")],
            )

    return texts.mapInArrow(run, schema)


def _with_places(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The texts that have places, with all of them; a text is shuffled only if it has any, where that can be told
    from a set of ids small enough to send to all tasks."""
    lists = stage(places.groupBy(*TEXT).agg(F.array_distinct(F.collect_list("place")).alias("places")), "places")
    some = texts.join(broadcast_if_small(lists.select(*TEXT)), TEXT, "left_semi")
    return some.join(lists.hint("merge"), TEXT)


TEXT = ["doc_id", "kind"]  # what a text is known by


def _told_apart(texts: DataFrame) -> DataFrame:
    """Add ``kind``: 0, or for ids with several different texts 31 bits of a hash of the text."""
    h = F.xxhash64("text")
    several = texts.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi")
    known = small_side(several.select("doc_id", F.lit(True).alias("several")), "several")
    return texts.join(known, "doc_id", "left").select(
        "doc_id", F.when(F.col("several"), h.bitwiseAND(F.lit(0x7FFFFFFF))).otherwise(0).cast("int").alias("kind"), "text"
    )


def remove_repeats(
    docs: DataFrame, window: int = 13, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` of every document, after removal of each word that lies in a
    window of ``window`` words which also starts in a document with a smaller id.

    Words are runs without blanks, unchanged; windows are judged on the input.  ``with_text`` adds the kept words
    joined by one space.  Null, empty and blank texts have no words.  Repeated rows are one document.  Different texts
    of one id are judged each on its own, and none of them by another, since their ids are equal.  A row without an id is
    neither judged nor a source.  An empty table gives no rows.  Windows are compared by 64-bit names, different texts of
    one id by 31 bits.  Texts may be of any length; columns beside id and text are never looked at.
    ``window`` is at least 11, so that four interior places can represent it, and at most 256.
    """
    if not 11 <= window <= len(_PLACE):
        raise ValueError("window must be from 11 to 256 words")
    texts = _told_apart(id_and_text(docs, id_col, text_col))
    named = texts.where("doc_id is not null")
    whole = stage(over_texts(texts, _whole, "doc_id bigint, kind int, n_words bigint, kept_sha256 string", tuple(TEXT)), "whole")
    words = whole.agg(F.sum("n_words")).first()[0] or 0
    buckets = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), words // (3 * BUCKET) + 1)
    marked = stage(_with_places(named, _marked(named, window, buckets)), "marked")
    cuts = stage(_with_places(marked.select(*TEXT, "text"), _repeated(marked, window, buckets)), "repeats")
    cut = kept_words(cuts, window, with_text)
    same = whole.join(cuts.select(*TEXT).distinct(), TEXT, "left_anti").withColumn("n_removed", F.lit(0).cast("bigint"))
    if with_text:
        plain = F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " "))
        words_of = named.dropDuplicates(TEXT).select(*TEXT, plain.alias("kept_text"))
        same = same.join(words_of, TEXT, "left").withColumn("kept_text", F.coalesce("kept_text", F.lit("")))
    return cut.unionByName(same.select(*cut.columns))
