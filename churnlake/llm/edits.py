"""Edit-aware token counts: a segment tree of token counts over the pre-tokens of each document.

The tree of a text is its pre-token lengths (leaves, in characters) and two arrays of subtree sums, one of
characters to find a place and one of tokens.  An edit re-encodes from a pre-token whose match can't have seen the
edited characters, through the new text, until a boundary of the new split meets an old one; from there on the old
leaves hold, because the split looks only ahead.  Changed leaves update the sums of their ancestors.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scan import grouped, id_and_text
from .tokens import ByteEncoder

BLOCK = 64  # leaves below a lowest inner node
CONTEXT = 2  # pre-tokens re-encoded before an edit; a match looks at most one character past its end

Edit = tuple[int, int, str]  # start, end (exclusive), replacement

PERSONAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{1,255}|\+?[0-9][0-9().-]{5,}[0-9]")


class CountTree:
    """Token counts of one text under edits; ``total`` is the count of the whole text."""

    def __init__(self, text: str, encoder: ByteEncoder, words: list[str] | None = None):
        self.encoder, self.text = encoder, text
        words = encoder.split(text) if words is None else words
        self.reencoded = 0
        chars, tokens = self._measured(words)
        self.blocks = [[chars[i : i + BLOCK], tokens[i : i + BLOCK]] for i in range(0, len(words), BLOCK)]
        self._sum_blocks()

    def _measured(self, words: list[str]) -> tuple[list[int], list[int]]:
        ids = self.encoder.ids
        try:
            return list(map(len, words)), list(map(len, map(ids.__getitem__, words)))
        except KeyError:
            self.encoder.ready(set(words))
        return list(map(len, words)), list(map(len, map(ids.__getitem__, words)))

    def _sum_blocks(self) -> None:
        """Sums of each block, and the levels above by pairs."""
        self.levels = [np.array([[sum(c), sum(t)] for c, t in self.blocks], dtype=np.int64).reshape(-1, 2)]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            if len(below) % 2:
                below = np.vstack([below, np.zeros((1, 2), dtype=np.int64)])
            self.levels.append(below[::2] + below[1::2])

    def _update(self, block: int) -> None:
        """New sums for one block and the path above it."""
        chars, tokens = self.blocks[block]
        change = np.array([sum(chars), sum(tokens)]) - self.levels[0][block]
        for level in self.levels:
            level[block] += change
            block //= 2

    @property
    def total(self) -> int:
        return int(self.levels[-1][0, 1]) if self.blocks else 0

    def _find(self, place: int) -> tuple[int, int, int]:
        """Block, leaf and first character of the pre-token that holds a character; the end counts to the last."""
        block, at = 0, 0
        for level in reversed(self.levels[:-1]):
            block *= 2
            if block + 1 < len(level) and place >= at + level[block, 0]:
                at += int(level[block, 0])
                block += 1
        chars = self.blocks[block][0]
        ends = np.cumsum(chars).tolist()
        leaf = min(bisect_right(ends, place - at), len(chars) - 1)
        return block, leaf, at + (ends[leaf - 1] if leaf else 0)

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace characters ``start`` to ``end`` of the present text."""
        old, self.text = self.text, self.text[:start] + put + self.text[end:]
        if not self.blocks or self.encoder.special_split and ("<|" in self.text or "<|" in old):
            self.__init__(self.text, self.encoder)  # a special token may span any boundary: the whole text is context
            return
        block, leaf, at = self._find(max(0, start - 1))
        for _ in range(CONTEXT):
            if leaf:
                leaf -= 1
            elif block:
                block -= 1
                leaf = len(self.blocks[block][0]) - 1
            else:
                break
            at -= self.blocks[block][0][leaf]
        shift = len(put) - (end - start)
        # old boundaries from the edit's end on, and the leaf that follows each
        b, i, place = block, leaf, at
        olds: dict[int, tuple[int, int]] = {}
        reach = end + 32
        while True:
            olds, b, i, place = self._boundaries(olds, b, i, place, end, reach)
            window = self.text[at : reach + shift]
            words, pos, meets = self.encoder.split(window), at, None
            taken = []
            last = reach >= len(old)
            for n, w in enumerate(words):
                if not last and n >= len(words) - 2:
                    break  # the window's end may have cut these
                taken.append(w)
                pos += len(w)
                if pos - shift in olds or pos == len(self.text):
                    meets = pos - shift
                    break
            if meets is not None or last:
                break
            reach += 2 * (reach - at)
        self.reencoded += sum(map(len, taken))
        chars, tokens = self._measured(taken)
        stop = olds.get(meets, (len(self.blocks), 0)) if meets is not None and meets < len(old) else (len(self.blocks), 0)
        self._splice(block, leaf, stop, chars, tokens)

    def _boundaries(self, olds, b, i, place, end, reach):
        while b < len(self.blocks) and place <= reach:
            if place >= end:
                olds[place] = (b, i)
            place += self.blocks[b][0][i]
            i += 1
            if i == len(self.blocks[b][0]):
                b, i = b + 1, 0
        return olds, b, i, place

    def _splice(self, block: int, leaf: int, stop: tuple[int, int], chars: list[int], tokens: list[int]) -> None:
        """Put new leaves in place of those from one leaf up to another."""
        to, upto = stop
        if to == block or to == block + 1 and upto == 0:
            part = self.blocks[block]
            upto = upto if to == block else len(part[0])
            part[0][leaf:upto], part[1][leaf:upto] = chars, tokens
            if part[0]:
                self._update(block)
                if len(part[0]) <= 4 * BLOCK:
                    return
        else:
            head = [c[:leaf] for c in self.blocks[block]]
            tail = [c[upto:] for c in self.blocks[to]] if to < len(self.blocks) else [[], []]
            self.blocks[block : to + 1] = [[head[0] + chars + tail[0], head[1] + tokens + tail[1]]]
        # a block has emptied, grown or joined others: cut it anew and rebuild the sums above
        joined = self.blocks[block]
        self.blocks[block : block + 1] = [
            [joined[0][k : k + BLOCK], joined[1][k : k + BLOCK]] for k in range(0, len(joined[0]), BLOCK)
        ]
        self._sum_blocks()


def personal_edits(text: str) -> list[Edit]:
    """Edits that put a mark in place of each address or long number, last first so that places stay right."""
    return [(m.start(), m.end(), "<redacted>") for m in PERSONAL.finditer(text)][::-1]


def count_under_edits(
    docs: DataFrame, path: str, find_edits=personal_edits, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, n_edits, n_tokens_after, n_reencoded``: tokens of each whole text, the edits that
    ``find_edits`` asks for (applied in turn), tokens afterwards from the tree, and the characters re-encoded for it.

    Null and empty texts have no tokens and no edits.  Repeated rows and null ids stay; an empty table gives no rows.
    """

    def run(batches):
        encoder = ByteEncoder.get(path)
        for batch in batches:
            rows = []
            for group in grouped(batch.column("text").cast(pa.binary()).to_pylist()):
                split = [encoder.split(t) for t in group]
                if any(w not in encoder.ids for words in split for w in words):
                    encoder.ready(set().union(*split))  # new pre-tokens of many texts are encoded together
                for text, words in zip(group, split):
                    tree = CountTree(text, encoder, words)
                    before, edits = tree.total, find_edits(text)
                    tree.reencoded = 0
                    for start, end, put in edits:
                        tree.edit(start, end, put)
                    rows.append((before, len(edits), tree.total, tree.reencoded))
            columns = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]],
                ["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded"],
            )

    schema = "doc_id bigint, n_tokens bigint, n_edits bigint, n_tokens_after bigint, n_reencoded bigint"
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
