"""Byte-level BPE by ranks: pieces from array scans, cached pair merging, and decoding by offsets.

A task encodes the distinct new pieces of many texts together: all their bytes stand in one array, and every round
merges in each piece the leftmost pair of lowest rank.  Results are cached by piece.  The vocabulary file and the class
table are read once by the driver and sent to the tasks; both are fixed in size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pretokens import code_point_classes, pieces
from .scan import OTHER_BYTE, grouped, hash_spans, id_and_text, over_texts

PIECES_KEPT, BYTES_KEPT = 200_000, 1 << 24  # bound the cache of a task; results don't depend on them
LONG_PIECE = 64  # bytes; longer pieces are merged one by one with a heap
_NONE = np.int64(1 << 30)


@dataclass
class Vocabulary:
    """Token bytes by rank, and the rank that each mergeable pair of tokens makes."""

    ranks: dict[bytes, int]
    classes: np.ndarray
    keys: np.ndarray = field(init=False)
    made: np.ndarray = field(init=False)

    def __post_init__(self):
        get, pairs = self.ranks.get, {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 30 | b] = rank
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.made = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in rows}, code_point_classes())


class Encoder:
    """Encodes pieces with a cache; one per process and vocabulary.

    The cache maps a piece to its ids as little-endian 32-bit bytes, as decimals with a comma after each, and to the
    bytes that the ids decode to.  It has two generations: a piece that is met again moves to the young one.
    """

    _made: dict[int, Encoder] = {}

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ranks = vocabulary.ranks
        most = max(self.ranks.values(), default=0) + 1
        self.token, self.decimal = [b""] * most, [f"{i}," for i in range(most)]
        for token, rank in self.ranks.items():
            self.token[rank] = token
        self.size = np.array([len(t) for t in self.token])
        self.shown_size = np.array([len(t) for t in self.decimal])
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.known: dict[bytes, tuple[bytes, str, bytes]] = {}
        self.old: dict[bytes, tuple[bytes, str, bytes]] = {}
        self.bytes = 0

    @classmethod
    def of(cls, shared) -> Encoder:
        """The encoder of a broadcast vocabulary, which a process holds once."""
        vocabulary = shared.value
        if id(vocabulary) not in cls._made:
            cls._made = {id(vocabulary): cls(vocabulary)}
        return cls._made[id(vocabulary)]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank that each pair merges into, or a number above all ranks."""
        wanted = left << 30 | right
        keys = self.vocabulary.keys
        if not len(keys):
            return np.full(len(wanted), _NONE)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, self.vocabulary.made[at], _NONE)

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact ids of all pieces one after another, and how many each has: a piece that is a token, or the leftmost
        pair of lowest rank merged until none is left."""
        whole = [self.ranks.get(w, -1) for w in words]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        single = np.array(whole, dtype=np.int64)
        long = np.flatnonzero((single < 0) & (sizes > LONG_PIECE))
        many = np.flatnonzero((single < 0) & (sizes <= LONG_PIECE) & (sizes > 0))
        done = [(np.flatnonzero(single >= 0), single[single >= 0])]
        for i in long.tolist():
            ids = self._merged_by_heap(words[i])
            done.append((np.full(len(ids), i), np.array(ids)))
        token = self.byte[np.frombuffer(b"".join([words[i] for i in many.tolist()]), dtype=np.uint8)]
        word = np.repeat(many, sizes[many])
        rank = np.full(len(token), _NONE)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.pair_ranks(token[inner], token[inner + 1])
        while len(token):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), first)
            open_ = (best >> 32) < _NONE
            keep = np.repeat(open_, np.diff(np.append(first, len(token))))
            done.append((word[~keep], token[~keep]))
            at = best[open_] & 0xFFFFFFFF
            token[at] = rank[at]
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            token, word, rank, at = token[keep], word[keep], rank[keep], place[at]
            touched = np.concatenate([at, at[at > 0] - 1])
            same = touched[touched + 1 < len(word)]
            same = same[word[same] == word[same + 1]]
            rank[at] = _NONE
            rank[same] = self.pair_ranks(token[same], token[same + 1])
        word, token = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(word, kind="stable")  # a piece is done at once, so its ids stay in order
        return token[order], np.bincount(word, minlength=len(words))

    def _merged_by_heap(self, word: bytes) -> tuple[int, ...]:
        token = self.byte[np.frombuffer(word, dtype=np.uint8)]
        ranks = self.pair_ranks(token[:-1], token[1:])
        token = token.tolist()
        n = len(token)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, token[i], token[i + 1]) for i, r in enumerate(ranks.tolist()) if r < _NONE]
        heapq.heapify(heap)
        raw, get = self.token, self.ranks.get
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue
            token[i], token[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else n
                if right < n:
                    made = get(raw[token[left]] + raw[token[right]])
                    if made is not None:
                        heapq.heappush(heap, (made, left, token[left], token[right]))
        return tuple(t for t in token if t >= 0)

    def ready(self, words: set[bytes]) -> None:
        """Put all of the pieces into the young cache."""
        known, old = self.known, self.old
        if len(known) > PIECES_KEPT or self.bytes > BYTES_KEPT:
            self.old, self.known, self.bytes = known, {}, 0
            known, old = self.known, self.old
        fresh = words.difference(known)
        self.bytes += sum(map(len, fresh))
        back = fresh.intersection(old)
        known.update((w, old[w]) for w in back)
        new = list(fresh.difference(back))
        if not new:
            return
        ids, counts = self.merged(new)
        ends = np.cumsum(counts)
        flat = ids.tolist()
        columns = []
        for whole, sizes in (
            (ids.astype("<i4").tobytes(), None),
            ("".join(map(self.decimal.__getitem__, flat)), self.shown_size),
            (b"".join(map(self.token.__getitem__, flat)), self.size),
        ):
            cuts = 4 * ends if sizes is None else np.append(0, np.cumsum(sizes[ids]))[ends]
            cuts = [0, *cuts.tolist()]
            columns.append([whole[a:b] for a, b in zip(cuts, cuts[1:])])
        known.update(zip(new, zip(*columns)))

    def split(self, texts: list[str]) -> _Group:
        """The texts' pieces, encoded.  Pieces are sorted out by two 64-bit names, so only distinct ones are cut out."""
        data, starts, first = pieces(texts, self.vocabulary.classes)
        ends = np.append(starts[1:], len(data))
        names = hash_spans(data, starts, ends)
        _, where, code = np.unique(names, return_index=True, return_inverse=True)
        other = hash_spans(data, starts, ends, OTHER_BYTE)
        raw = data.tobytes()
        if (other != other[where[code]]).any() or (ends - starts != (ends - starts)[where[code]]).any():
            every = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]  # two pieces share a name
            place = {w: i for i, w in enumerate(dict.fromkeys(every))}
            distinct, code = list(place), np.array([place[w] for w in every])
        else:
            distinct = [raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())]
        self.ready(set(distinct))
        return _Group([self.known[w] for w in distinct], code, starts, first)


class _Group:
    """The encoded pieces of some texts: what is known of each distinct one, and the number of every piece."""

    def __init__(self, known: list[tuple[bytes, str, bytes]], code: np.ndarray, starts: np.ndarray, first: np.ndarray):
        self.packed, self.shown, self.raw = (list(c) for c in zip(*known))
        edges = [*first.tolist(), len(code)]
        self.cuts = list(zip(edges, [b - 1 for b in edges[1:]]))  # without the joining characters
        self.code, self.starts = code, starts

    def texts(self) -> Iterator[tuple[list[int], np.ndarray]]:
        """For each text the numbers of its pieces, and the bytes of it at which they start."""
        for a, b in self.cuts:
            yield self.code[a:b].tolist(), self.starts[a:b] - self.starts[a]


def _shared(df: DataFrame, path: str):
    return df.sparkSession.sparkContext.broadcast(Vocabulary.read(path))


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: the exact ids of each whole text and the byte at which each id's bytes start.

    Null and empty texts have no ids.  Repeated rows and null ids stay; an empty table gives no rows; columns beside id
    and text are never looked at.  A text of any length is scanned in windows with a carried state.
    """
    rows = id_and_text(docs, id_col, text_col)
    shared = _shared(rows, path)

    def make(texts: list[bytes]) -> dict:
        encoder = Encoder.of(shared)
        ids, offsets = [], []
        for group in grouped(texts):
            split = encoder.split(group)
            for words, places in split.texts():
                known = [split.packed[w] for w in words]
                found = np.frombuffer(b"".join(known), dtype="<i4")
                sizes = encoder.size[found]
                inside = np.cumsum(sizes) - sizes
                counts = np.array([len(k) // 4 for k in known], dtype=np.int64)
                ids.append(found)
                offsets.append(np.repeat(places - inside[np.cumsum(counts) - counts], counts) + inside)
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "offsets": pa.array(offsets, pa.list_(pa.int64()))}

    return over_texts(rows, make, "doc_id bigint, ids array<int>, offsets array<bigint>")


def decode_ids(encoded: DataFrame, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """``doc_id, raw`` (binary): the bytes ``start`` to ``stop`` of each text from ``doc_id, ids, offsets``.

    The offsets lead to the ids that hold these bytes, so no other id is decoded.  Rows without ids are empty.
    """
    shared = _shared(encoded, path)

    def part(token: list[bytes], ids: list[int], offsets: np.ndarray) -> bytes:
        low = max(0, int(np.searchsorted(offsets, start, side="right")) - 1)
        high = len(ids) if stop is None else int(np.searchsorted(offsets, stop))
        if low >= high:
            return b""
        shift = int(offsets[low])
        return b"".join(token[i] for i in ids[low:high])[max(0, start - shift) : None if stop is None else stop - shift]

    def run(batches):
        token = Encoder.of(shared).token
        for batch in batches:
            rows = zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist())
            raw = [part(token, ids or [], np.array(offsets or [], dtype=np.int64)) for ids, offsets in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return encoded.select("doc_id", "ids", "offsets").mapInArrow(run, "doc_id bigint, raw binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each whole text, encoded and decoded in one pass.

    The digests are of the decimal ids joined by commas, and of the decoded bytes.  They are fed from the cached ids of
    each piece, in the order of the offsets.  Edge cases as in :func:`encode_texts`.
    """
    rows = id_and_text(docs, id_col, text_col)
    shared = _shared(rows, path)

    def make(texts: list[bytes]) -> dict:
        encoder = Encoder.of(shared)
        counts, ids, decoded = [], [], []
        for group in grouped(texts):
            split = encoder.split(group)
            for words, _ in split.texts():
                line = "".join(map(split.shown.__getitem__, words))
                counts.append(line.count(","))
                ids.append(hashlib.sha256(line[:-1].encode()).hexdigest())
                decoded.append(hashlib.sha256(b"".join(map(split.raw.__getitem__, words))).hexdigest())
        return {
            "n_tokens": pa.array(counts, pa.int64()),
            "ids_sha256": pa.array(ids, pa.string()),
            "decoded_sha256": pa.array(decoded, pa.string()),
        }

    return over_texts(rows, make, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
