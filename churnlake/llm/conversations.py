"""Prefix trie of conversations, built from z-fast tries.

A conversation becomes its prefix keys: 128-bit digests that are the XOR of one digest per turn and depth, so that long
conversations can be cut into segments anywhere.  Every task inserts its segments, batch by batch, into compacted
z-fast tries: each compacted node is found in a hash table by the prefix at the two-fattest depth of its edge, a fat
binary search over that table leads to a conversation's exit node, and only there an edge is split.  A full batch is
expanded: each edge gives its nodes with sums over their members, which Spark adds up by prefix key.  So a prefix that
a third of all conversations share is one row per batch, and no task holds more than a batch.

Sums over subtrees need no walk.  The smallest member owns a node; what a conversation owns is one path, from some
depth to its end.  The second round of tries sums, for each node, the paths of the owners that pass through it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.ranking import running_totals
from ..session import stage

SEGMENT = 512  # turns of one row at most, but for a few head turns
BATCH_TURNS = 1 << 18  # turns in a task's tries before they are expanded
GROUP, HEAD, CHUNK, HOT_PARENTS = 100, 6, 4096, 512
KEY = ["k1", "k2", "depth"]
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_NODES = (
    "k1 bigint, k2 bigint, depth bigint, p1 bigint, p2 bigint, before bigint, chars bigint, "
    "owner bigint, top bigint, attach bigint, n bigint, v1 bigint, v2 bigint, longest bigint"
)


# Rebuilding


def ordered_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, pos, t1, t2, chars``: the turns of each conversation numbered from 1, texts replaced by digests."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = rows.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.char_length(text).cast("bigint").alias("chars"),
        F.lit(1).alias("one"),
    )
    # No conversation is one window: positions add up over slices of a range partitioning.
    placed = running_totals(turns, ["conv_id"], ["turn", "role", "digest"], {"pos": "one"})
    return placed.select(
        "conv_id", "pos", *[F.xxhash64(F.lit(i), "role", "digest").alias(f"t{i}") for i in (1, 2)], "chars"
    )


def segments(rows: DataFrame) -> DataFrame:
    """Rebuilt conversations in segments: ``conv_id, first`` (turns before), ``s1, s2`` (key there), ``before`` (code
    points before), ``e1, e2, chars`` (a digest at its depth and the code points of each turn), ``x1, x2`` (key at the
    end), ``length, total`` (turns and code points of the whole conversation)."""
    turns = stage(ordered_turns(rows), "turns")
    item = F.struct("pos", "t1", "t2", "chars")
    heads = (
        turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEAD))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(item)).alias("head"))
    )
    taken = F.crc32(F.col("conv_id").cast("string")) % HEAD
    listed = turns.where(F.col("pos") == 1).select("conv_id", taken.cast("int").alias("h"))
    base = listed.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    # A base has fewer than 200 conversations.
    known = base.join(heads, "base", "left").select(
        "conv_id", "h", F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast(heads.schema["head"].dataType)).alias("head")
    )
    own = (
        turns.where(F.col("pos") > taken)
        .groupBy("conv_id", F.floor((F.col("pos") - 1) / SEGMENT).cast("bigint").alias("part"))
        .agg(F.sort_array(F.collect_list(item)).alias("own"))
    )
    part = F.coalesce("part", F.lit(0))
    given = F.size("head")
    items = F.when(part == 0, F.concat("head", F.coalesce("own", F.array().cast(heads.schema["head"].dataType)))).otherwise(F.col("own"))
    cut = known.join(own, "conv_id", "left").select(
        "conv_id",
        F.when(part == 0, 0).otherwise(part * SEGMENT - F.col("h") + given).cast("bigint").alias("first"),
        items.alias("items"),
    )

    def digests(lane: int) -> Column:
        return F.transform("items", lambda x, i: F.xxhash64(F.lit(lane), x["t1"], x["t2"], F.col("first") + i))

    keyed = cut.select(
        "conv_id", "first", digests(1).alias("e1"), digests(2).alias("e2"), F.col("items.chars").alias("chars")
    ).withColumns(
        {f"y{i}": F.aggregate(f"e{i}", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)) for i in (1, 2)}
        | {"spent": F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)}
    )
    # The join has dealt by conversation already; a window sees one row per 512 turns.
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumns(
        {f"s{i}": F.coalesce(F.bit_xor(f"y{i}").over(earlier), F.lit(0)) for i in (1, 2)}
        | {
            "before": F.coalesce(F.sum("spent").over(earlier), F.lit(0)),
            "length": F.sum(F.size("e1")).over(whole).cast("bigint"),
            "total": F.sum("spent").over(whole),
        }
    )
    return placed.select(
        "conv_id", "first", "s1", "s2", "before", "e1", "e2", "chars", "length", "total",
        *[F.col(f"s{i}").bitwiseXOR(F.col(f"y{i}")).alias(f"x{i}") for i in (1, 2)],
    )


# The z-fast trie


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


class ZFastTrie:
    """Compacted trie of segments that start at one prefix.

    Node ``i`` ends the edge from depth ``low[i]`` to ``end[i]`` of the key list ``path[i]``, whose entry ``d - first``
    is the key at depth d.  ``handles`` finds a node by the key at the two-fattest depth of its edge, ``names`` by the
    key one below its parent.  ``held`` has the values of the segments that end at a node.
    """

    def __init__(self, first: int, key: tuple[int, int]):
        self.first = first
        self.low, self.end, self.parent = [first], [first], [-1]
        self.path: list[list[tuple[int, int]]] = [[key]]
        self.source = [-1]
        self.held: list[list | None] = [None]
        self.handles: dict[tuple[int, int], int] = {}
        self.names: dict[tuple[int, int], int] = {}

    def exit(self, keys: list[tuple[int, int]]) -> tuple[int, int]:
        """The exit node of a key list, and the depth to which the list follows the trie."""
        first, low, high, node = self.first, self.first, self.first + len(keys) - 1, 0
        last = high
        while low < high:
            depth = fattest(low, high)
            hit = self.handles.get(keys[depth - first])
            if hit is None:
                high = depth - 1
            else:
                node, low = hit, self.end[hit]
        end = self.end[node]
        if end < last and keys[end - first] == self.path[node][end - first]:
            node = self.names.get(keys[end + 1 - first], node)
        path = self.path[node]
        a, b = self.low[node], min(self.end[node], last)
        while a < b:  # equal up to a; prefixes are equal up to some depth and never again
            middle = (a + b + 1) // 2
            if keys[middle - first] == path[middle - first]:
                a = middle
            else:
                b = middle - 1
        return node, a

    def _add(self, low: int, end: int, parent: int, path: list, source: int) -> int:
        for part, value in (
            (self.low, low), (self.end, end), (self.parent, parent), (self.path, path), (self.source, source), (self.held, None),
        ):
            part.append(value)
        node = len(self.low) - 1
        self._enter(node)
        return node

    def _enter(self, node: int) -> None:
        path, low = self.path[node], self.low[node]
        self.names[path[low + 1 - self.first]] = node
        self.handles[path[fattest(low, self.end[node]) - self.first]] = node

    def insert(self, keys: list[tuple[int, int]], source: int) -> int:
        """The node that the key list ends at; an edge is split at most once and a leaf added at most once."""
        node, depth = self.exit(keys)
        if depth < self.end[node]:
            path, low = self.path[node], self.low[node]
            del self.handles[path[fattest(low, self.end[node]) - self.first]]
            upper = self._add(low, depth, self.parent[node], path, self.source[node])
            self.low[node], self.parent[node] = depth, upper
            self._enter(node)
            node = upper
        last = self.first + len(keys) - 1
        return self._add(depth, last, node, keys, source) if depth < last else node

    def totals(self) -> list[list | None]:
        """The values of all segments through each node: smallest owner with its path, sums, greatest length."""
        out = [list(h) if h else None for h in self.held]
        for node in sorted(range(1, len(self.low)), key=self.end.__getitem__, reverse=True):
            up = self.parent[node]
            out[up] = out[node][:] if out[up] is None else _joined(out[up], out[node])
        return out


def _joined(a: list, b: list) -> list:
    return [min(a[0], b[0]), a[1] + b[1], a[2] + b[2], a[3] + b[3], max(a[4], b[4])]


class _Batch:
    """The tries of a batch of segments, one for each prefix that segments start at."""

    def __init__(self):
        self.tries: dict[tuple[int, int, int], ZFastTrie] = {}
        self.spent: list[np.ndarray] = []  # code points before each depth of a source
        self.size = 0

    def add(self, first: int, k1: np.ndarray, k2: np.ndarray, spent: np.ndarray, values: list) -> None:
        keys = list(zip(k1.tolist(), k2.tolist()))
        trie = self.tries.get((first, *keys[0]))
        if trie is None:
            trie = self.tries[first, *keys[0]] = ZFastTrie(first, keys[0])
        before = len(trie.low)
        node = trie.insert(keys, len(self.spent))
        held = trie.held[node]
        trie.held[node] = values if held is None else _joined(held, values)
        if len(trie.low) > before:
            self.spent.append(spent)
            self.size += len(keys)
        self.size += 1

    def expanded(self) -> pa.RecordBatch:
        """One row per node of the uncompacted tries."""
        keys, places, per_edge, counts = [], [], [], []
        for (first, *_), trie in self.tries.items():
            for node, values in enumerate(trie.totals()):
                if node == 0:
                    if first == 0:
                        keys.append(np.array([[0, 0, 0, 0, 0]], dtype=np.int64))
                        places.append(np.zeros((1, 2), dtype=np.int64))
                        per_edge.append(values)
                        counts.append(1)
                    continue
                low, end = trie.low[node], trie.end[node]
                on = np.array(trie.path[node][low - first : end + 1 - first], dtype=np.int64)
                depth = np.arange(low + 1, end + 1)[:, None]
                keys.append(np.hstack([on[1:], depth, on[:-1]]))
                spent = self.spent[trie.source[node]][low - first : end + 1 - first]
                places.append(np.stack([spent[:-1], np.diff(spent)], axis=1))
                per_edge.append(values)
                counts.append(end - low)
        flat = np.array([[*v[0], *v[1:]] for v in per_edge], dtype=np.int64).reshape(-1, 7)
        table = np.hstack([
            np.concatenate(keys or [np.empty((0, 5), dtype=np.int64)]),
            np.concatenate(places or [np.empty((0, 2), dtype=np.int64)]),
            np.repeat(flat, counts, axis=0),
        ])
        names = [part.split()[0] for part in _NODES.split(",")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(table.T)], names)


def _batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batch = _Batch()
    for part in parts:
        columns = {c: part.column(c) for c in part.schema.names}
        flat = {c: columns[c].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("e1", "e2", "chars")}
        ends = np.concatenate([[0], np.cumsum(columns["e1"].value_lengths().to_numpy(zero_copy_only=False))])
        plain = {c: columns[c].to_pylist() for c in columns if c not in flat}
        for i in range(part.num_rows):
            cut = slice(ends[i], ends[i + 1])
            lanes = [np.bitwise_xor.accumulate(np.concatenate([[plain[s][i]], flat[e][cut]])) for s, e in (("s1", "e1"), ("s2", "e2"))]
            spent = np.cumsum(np.concatenate([[plain["before"][i]], flat["chars"][cut]]))
            owner = (plain["conv_id"][i], plain["top"][i], plain["attach"][i])
            batch.add(plain["first"][i], *lanes, spent, [owner, 1, plain["v1"][i], plain["v2"][i], plain["length"][i]])
            if batch.size >= BATCH_TURNS:
                yield batch.expanded()
                batch = _Batch()
    yield batch.expanded()


def trie_nodes(parts: DataFrame, v1: str, v2: Column, top: Column, attach: Column) -> DataFrame:
    """One row per prefix of the segments' conversations: its smallest member with that one's ``top`` and ``attach``,
    the number of members, their sums of ``v1`` and ``v2``, and the greatest length among them."""
    given = parts.select(
        "conv_id", "first", "s1", "s2", "before", "e1", "e2", "chars", "length",
        F.col(v1).alias("v1"), v2.cast("bigint").alias("v2"), top.cast("bigint").alias("top"), attach.cast("bigint").alias("attach"),
    )
    found = given.mapInArrow(_batches, _NODES).groupBy(*KEY).agg(
        *[F.min(c).alias(c) for c in ("p1", "p2", "before", "chars")],
        F.min(F.struct("owner", "top", "attach")).alias("by"),
        *[F.sum(c).alias(c) for c in ("n", "v1", "v2")],
        F.max("longest").alias("longest"),
    )
    return found.select("*", "by.*").drop("by")


# The digests of the members that end at a node


def end_digests(parts: DataFrame) -> DataFrame:
    """``k1, k2, depth, ends_sha256``: the digest of the sorted, comma-joined ids of the conversations that end there.

    Ids travel as joined runs of at most 4096; one task streams the runs of a node through the hash.
    """
    ends = parts.where(F.col("first") + F.size("e1") == F.col("length")).select(
        F.col("x1").alias("k1"), F.col("x2").alias("k2"), F.col("length").alias("depth"), "conv_id"
    )
    runs = ends.groupBy(*KEY, F.floor(F.col("conv_id") / CHUNK).alias("run")).agg(
        F.concat_ws(",", F.sort_array(F.collect_list("conv_id")).cast("array<string>")).alias("ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, hashlib.sha256()
        for batch in batches:
            done: list[tuple] = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == open_:
                    state.update(b"," + ids.encode())
                else:
                    if open_:
                        done.append((*open_, state.hexdigest()))
                    open_, state = key, hashlib.sha256(ids.encode())
            if done:
                yield _digest_rows(done)
        if open_:
            yield _digest_rows([(*open_, state.hexdigest())])

    dealt = runs.repartition(*KEY).sortWithinPartitions(*KEY, "run")
    return dealt.mapInArrow(digest, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], [*KEY, "ends_sha256"])


# The whole trie


def prefix_trie(rows: DataFrame) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: ``conv_id`` (smallest member), ``depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Turns go by number, nulls first; turns with one number by role, then by SHA-256 of the text.  Null roles and texts
    are empty.  Repeated rows are turns of their own.  Rows without a conversation id take no part; an empty table gives
    no rows; other columns are never looked at.  Conversations, texts and groups of copies may be of any size.  Prefixes
    are told apart by 128-bit digests.
    """
    parts = stage(segments(rows), "segments")
    zero = F.lit(0)
    nodes = stage(trie_nodes(parts, "total", zero, zero, zero).drop("top", "attach", "v2"), "nodes")
    paths = (
        nodes.where("depth > 0")
        .groupBy(F.col("owner").alias("conv_id"))
        .agg(
            (F.min("depth") - 1).alias("attach"),
            F.min("before").alias("top"),
            F.sum("chars").alias("own"),
            F.count_if(F.col("longest") == F.col("depth")).alias("leaf"),
        )
    )
    owners = parts.join(paths, "conv_id")
    sums = trie_nodes(owners, "own", F.col("leaf"), F.col("top"), F.col("attach")).select(
        *KEY, "top", "attach", F.col("v1").alias("own"), F.col("v2").alias("leaves")
    )
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    # Keys are unique on every side of these joins.
    known = (
        nodes.join(sums, KEY, "left")
        .join(children.agg(F.count(F.lit(1)).alias("n_children")), KEY, "left")
        .join(end_digests(parts), KEY, "left")
    )
    distinct = F.col("own") - (F.col("before") - F.col("top"))
    kept = F.col("v1") - F.col("n") * F.col("before")
    table = stage(
        known.select(
            *KEY, "p1", "p2", F.col("owner").alias("conv_id"), F.coalesce("attach", F.lit(0)).alias("attach"),
            F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.coalesce("leaves", F.lit(1)).alias("n_leaves"),
            (kept - F.coalesce(distinct, F.lit(0))).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        ),
        "trie",
    )
    return _with_parents(table)


def _with_parents(table: DataFrame) -> DataFrame:
    """Name each node's parent.  Only the top node of a path has one that another conversation owns; nodes with many
    children, at most ``HOT_PARENTS`` of them, are sent to all tasks, and all others are joined by key."""
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = (F.col("depth") > 0) & (F.col("depth") == F.col("attach") + 1)
    inner = table.where(~top).withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    many = F.lit(table.count() // HOT_PARENTS)
    parent = [F.col("k1").alias("p1"), F.col("k2").alias("p2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id")]
    on = ["p1", "p2", "depth"]
    hot = F.broadcast(table.where(F.col("n_children") > many).select(*parent))
    cold = table.where((F.col("n_children") <= many) & (F.col("n_children") > 0)).select(*parent)
    tops = table.where(top)
    return (
        inner.select(*out)
        .unionByName(tops.join(hot, on).select(*out))
        .unionByName(tops.join(hot.drop("parent_conv_id"), on, "left_anti").join(cold, on).select(*out))
    )
