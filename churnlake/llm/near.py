"""Near duplicates: a chosen-path set similarity join over word shingles, confirmed on full sets.

Documents with equal shingle sets form one class.  Classes carry a minwise signature.  In each of several
independent trees a node picks coordinates of the signature (as many as keep a pair at the threshold alive on
average) and sends a class to the child named by its value there.  Nodes of one class end; large nodes go on to more
levels; small ones are compared exhaustively by signature.  Candidates are confirmed by exact set sizes:

1. every class proposes its most similar smaller class, at most one link a class;
2. after these are joined up, all candidate pairs between different components are confirmed, so that no link
   that could join two components is missed.  Pairs inside a component need no confirmation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import broadcast_if_small
from ..session import stage
from .exact import join_to_groups
from .scan import id_and_text, mixed, over_texts, scan_texts

COORDINATES = 128  # of a signature, 16 bits each
TREES = 12
LEVELS = 4  # of a tree before its nodes are counted, and from one count to the next
MAX_LEVEL = 24  # classes still together here agree in all those coordinates; see _leaves
NODE = 1024  # classes compared exhaustively at once
SET_ROWS = 500  # full sets handed on at once; they are as large as the texts
SLACK = 4.0  # standard deviations of the signature's estimate below the threshold that still make a candidate

_RNG = np.random.default_rng(61)
_MULTIPLY = _RNG.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per group of texts: the first one's number, all distinct shingles in text order and then ascending, and where
    each text's begin (one more entry closes the last).  Texts with fewer words have one shingle, empty ones none."""
    for at, _, _, _, names, firsts in scan_texts([t.lower() for t in texts]):
        n, words = len(firsts) - 1, np.diff(firsts)
        doc = np.repeat(np.arange(n), words)
        left = firsts[1:][doc] - np.arange(len(names))  # words from here to the text's end
        sums = np.zeros(len(names), dtype=np.uint64)
        for j in range(width):
            reach = max(0, len(names) - j)
            inside = left[:reach] > j
            sums[:reach] += np.where(inside, names[j:] * _PLACE[j], np.uint64(0))
        use = (left >= width) | ((words[doc] < width) & (np.arange(len(names)) == firsts[:-1][doc]))
        values, of = mixed(sums[use] + words[doc[use]].clip(max=width).astype(np.uint64)), doc[use]
        order = np.lexsort((values, of))
        values, of = values[order], of[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
        values, of = values[new], of[new]
        yield at, values, np.searchsorted(of, np.arange(n + 1))


def signatures(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Minwise signatures of the non-empty slices of ``values``; 0 for empty ones."""
    out = np.zeros((len(firsts) - 1, COORDINATES), dtype="<u2")
    full = np.flatnonzero(firsts[1:] > firsts[:-1])
    if len(full):
        starts = firsts[full]
        for i, m in enumerate(_MULTIPLY):
            out[full, i] = np.minimum.reduceat(values * m, starts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)
    return out


def digests(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_name, signature`` of each text; a text without words has a null name."""

    def make(texts: list[bytes]) -> dict:
        counts, names, sigs = [], [], []
        for _, values, firsts in shingle_sets(texts, width):
            counts += np.diff(firsts).tolist()
            sigs += [s.tobytes() for s in signatures(values, firsts)]
            for a, b in zip(firsts[:-1], firsts[1:]):
                names.append(xxhash.xxh3_128_digest(values[a:b].tobytes()) if b > a else None)
        return {
            "n_shingles": pa.array(counts, pa.int64()),
            "set_name": pa.array(names, pa.binary()),
            "signature": pa.array(sigs, pa.binary()),
        }

    return over_texts(docs, make, "doc_id bigint, n_shingles bigint, set_name binary, signature binary")


def _descend(keys: np.ndarray, row: np.ndarray, sigs: np.ndarray, levels: int, branch: float):
    """Follow the chosen paths some levels down: keys of the nodes reached, and the row of each."""
    for _ in range(levels):
        draw = mixed(keys)
        first = (draw & np.uint64(COORDINATES - 1)).astype(int)
        second = (draw >> np.uint64(8) & np.uint64(COORDINATES - 1)).astype(int)
        both = (draw >> np.uint64(16)).astype(float) / 2.0**48 < branch
        both &= first != second
        parts = []
        for take, coordinate in ((np.ones(len(keys), dtype=bool), first), (both, second)):
            r, c = row[take], coordinate[take]
            parts.append((mixed(draw[take] + _PLACE[0] * (c.astype(np.uint64) << np.uint64(16) | sigs[r, c])), r))
        keys, row = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    return keys, row


def _sig_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("signature").to_pylist()), dtype="<u2").reshape(-1, COORDINATES)


def _paths(classes: DataFrame, branch: float) -> DataFrame:
    """``node, class_id``: the nodes of all trees that each class reaches."""

    def run(batches):
        for batch in batches:
            sigs, ids = _sig_rows(batch), batch.column("class_id").to_numpy()
            roots = mixed(np.arange(1, TREES + 1, dtype=np.uint64))
            keys, row = _descend(np.repeat(roots, len(ids)), np.tile(np.arange(len(ids)), TREES), sigs, LEVELS, branch)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(ids[row])], ["node", "class_id"])

    return classes.select("class_id", "signature").mapInArrow(run, "node bigint, class_id bigint")


def _deeper(members: DataFrame, branch: float) -> DataFrame:
    def run(batches):
        for batch in batches:
            sigs, ids = _sig_rows(batch), batch.column("class_id").to_numpy()
            keys, row = _descend(batch.column("node").to_numpy().view("u8"), np.arange(len(ids)), sigs, LEVELS, branch)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view("i8")), pa.array(ids[row])], ["node", "class_id"])

    return members.select("node", "class_id", "signature").mapInArrow(run, "node bigint, class_id bigint")


def _leaves(classes: DataFrame, branch: float) -> DataFrame:
    """``node, class_id`` of nodes with at least two and at most about ``NODE`` classes.

    A node still larger at ``MAX_LEVEL`` holds classes that agree in all its coordinates.  It is dealt by hash into
    parts of about half of ``NODE``, and every two parts make a node, so that no two classes are kept apart.
    """
    paths, out = stage(_paths(classes, branch), "paths"), None
    for level in range(LEVELS, MAX_LEVEL + 1, LEVELS):
        sizes = paths.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
        held = stage(paths.join(sizes.where("size > 1"), "node"), "nodes")
        small = held.where(F.col("size") <= NODE).select("node", "class_id")
        out = small if out is None else out.unionByName(small)
        large = held.where(F.col("size") > NODE)
        if large.isEmpty():
            return out
        if level < MAX_LEVEL:
            paths = stage(_deeper(large.join(classes, "class_id"), branch), "paths")
    parts = (2 * F.ceil(F.col("size") / NODE)).cast("int")
    own = large.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("class_id", "node"), F.col("parts")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> own")
    pair = F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other"))
    return out.unionByName(met.select(pair.alias("node"), "class_id"))


def _by_node(batches):
    """Rows of one node after another, from batches sorted by node; a node may cross batches.  Only such a node is
    copied, so that a batch is given up with its last node."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        nodes = batch.column("node").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(nodes)) + 1).tolist(), len(nodes)]
        for a, b in zip(cuts, cuts[1:]):
            if rest and rest[0].column("node")[0].as_py() != nodes[a]:
                yield _one(rest)
                rest = []
            if b == len(nodes):
                rest.append(batch.slice(a, b - a).take(pa.array(np.arange(b - a))))
            elif rest:
                yield _one([*rest, batch.slice(a, b - a)])
                rest = []
            else:
                yield batch.slice(a, b - a)
    if rest:
        yield _one(rest)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _links(members: DataFrame, least: float, percent: int) -> DataFrame:
    """``a, b``: confirmed links inside nodes between different components.

    ``members`` has ``component`` and the full ``shingles`` of each class.  Every candidate pair of a node is confirmed
    on the sets unless links found before have joined its components, so only links leave the task, fewer than classes.
    """

    def run(batches):
        for node in _by_node(batches):
            ids, parts = node.column("class_id").to_numpy(), node.column("component").to_numpy().copy()
            sigs, sets = _sig_rows(node), node.column("shingles")
            found: list[tuple[int, int]] = []
            for j in range(1, len(ids)):
                agree = np.count_nonzero(sigs[:j] == sigs[j], axis=1)
                near = np.flatnonzero((agree >= least * COORDINATES) & (parts[:j] != parts[j]))
                mine = sets[j].values.to_numpy()
                for i in near[np.argsort(-agree[near], kind="stable")].tolist():
                    if parts[i] == parts[j]:
                        continue
                    other = sets[i].values.to_numpy()
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if 100 * both >= percent * (len(mine) + len(other) - both):
                        found.append((int(ids[j]), int(ids[i])))
                        parts[parts == parts[j]] = parts[i]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    columns = ["node", "class_id", "signature", "component", "shingles"]
    return members.select(*columns).repartition("node").sortWithinPartitions("node").mapInArrow(run, "a bigint, b bigint")


def _best_partners(members: DataFrame, least: float) -> DataFrame:
    """``a, b, agree``: inside each node the most similar smaller class of every class, if it is a candidate.  A class
    that is a candidate of larger ones only has a row with itself, so that none with a candidate is left out."""

    def run(batches):
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush():
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0, np.int32)]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "agree"])

        for node in _by_node(batches):
            order = np.argsort(node.column("class_id").to_numpy(), kind="stable")
            ids, sigs = node.column("class_id").to_numpy()[order], _sig_rows(node)[order]
            asked, proposed = np.zeros(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool)
            for j in range(1, len(ids)):
                agree = np.count_nonzero(sigs[:j] == sigs[j], axis=1).astype("i4")
                best = np.argmax(agree)
                if agree[best] >= least * COORDINATES:
                    asked[:j] |= agree >= least * COORDINATES
                    proposed[j] = True
                    found.append((ids[j : j + 1], ids[best : best + 1], agree[best : best + 1]))
                    waiting += 1
            alone = ids[asked & ~proposed]
            if len(alone):
                found.append((alone, alone, np.zeros(len(alone), dtype="i4")))
                waiting += len(alone)
            if waiting > 50_000:
                yield flush()
                waiting = 0
        yield flush()

    return (
        members.select("node", "class_id", "signature")
        .repartition("node")
        .sortWithinPartitions("node")
        .mapInArrow(run, "a bigint, b bigint, agree int")
    )


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``class_id, shingles`` of the documents with these ids."""

    def make(texts: list[bytes]) -> dict:
        lists = []
        for _, values, firsts in shingle_sets(texts, width):
            lists += [values[a:b].view("i8") for a, b in zip(firsts[:-1], firsts[1:])]
        return {"shingles": pa.array(lists, pa.list_(pa.int64()))}

    wanted = docs.join(broadcast_if_small(ids), "doc_id", "left_semi")
    return over_texts(wanted, make, "doc_id bigint, shingles array<bigint>", rows=SET_ROWS).dropDuplicates(["doc_id"])


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the threshold."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "involved")
    sets = stage(_sets(docs, ids, width), "sets")
    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = 100 * both >= percent * (F.size("sa") + F.size("sb") - both)
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(near).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``class_id, component`` (the smallest id reachable) of all ids in ``links`` (``a, b``).

    Alternates the large and the small star until nothing changes; every round is written to the shared folder.
    """
    links = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = None
    while True:
        sides = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    roots = links.select(F.col("b").alias("class_id"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("class_id"), F.col("b").alias("component")).unionByName(roots)


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked, directly or through others, by a Jaccard
    similarity of at least ``percent`` hundredths between their sets of ``width``-word shingles.

    Words are runs without blanks, ASCII letters lower-cased.  A shorter text is one shingle; a null, empty or blank
    text has none and no links.  ``component_id`` is the smallest id reachable.  Repeated rows are copies with one id.
    A row without an id is not linked unless its set equals that of one with an id, and never kept.  An empty table
    gives no rows.  Sets are of 64-bit shingle names.  A pair at the threshold shares no node of any tree with
    probability below 1e-5 (0.36 to the twelfth).
    """
    texts = id_and_text(docs, id_col, text_col)
    branch, least = 100 / percent - 1, percent / 100
    least -= SLACK * (least * (1 - least) / COORDINATES) ** 0.5
    rows = stage(digests(texts, width), "digests")
    classes = stage(
        rows.where("set_name is not null")
        .groupBy("set_name")
        .agg(
            F.min("doc_id").alias("class_id"),
            F.count(F.lit(1)).alias("group_size"),
            F.min_by("signature", "doc_id").alias("signature"),
        ),
        "classes",
    )
    known = classes.where("class_id is not null").select("class_id", "signature")
    leaves = stage(_leaves(known, branch), "leaves")
    best = _best_partners(leaves.join(known, "class_id"), least)
    best = stage(best.groupBy("a").agg(F.max_by("b", F.struct("agree", -F.col("b"))).alias("b")), "best")
    links = stage(_confirmed(texts, best.where("a <> b"), width, percent), "confirmed")
    joined = stage(components(links), "components")
    # nodes whose classes aren't all in one component yet
    placed = leaves.join(joined, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    mixed_nodes = placed.groupBy("node").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    involved = best.select(F.explode(F.array("a", "b")).alias("class_id")).distinct()
    open_nodes = placed.join(mixed_nodes.select("node"), "node", "left_semi").join(involved, "class_id", "left_semi")
    open_nodes = stage(open_nodes, "open")
    ids = stage(open_nodes.select(F.col("class_id").alias("doc_id")).distinct(), "involved")
    sets = stage(_sets(texts, ids, width).withColumnRenamed("doc_id", "class_id"), "sets")
    more = _links(open_nodes.join(known, "class_id").join(sets, "class_id"), least, percent)
    more = stage(more.distinct(), "confirmed")
    joined = stage(components(links.unionByName(more)), "components") if not more.isEmpty() else joined
    named = classes.select("set_name", "class_id", "group_size").join(joined, "class_id", "left")
    groups = stage(named.select("set_name", "group_size", F.coalesce("component", "class_id").alias("component_id")), "named")
    full = join_to_groups(rows.where("set_name is not null").select("doc_id", "n_shingles", "set_name"), groups, "set_name")
    alone = rows.where("set_name is null").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", "n_shingles", "component_id"]
    return full.select(*columns).unionByName(alone.select(*columns)).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )
