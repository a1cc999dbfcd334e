"""Byte-level BPE by speculation and verification, and a word cache for the word-end vocabulary.

A tokenizer's pre-tokens repeat a lot, so each task encodes distinct ones and joins cached results.  New
pre-tokens are encoded together: an automaton over the vocabulary proposes the greedy longest matches, a table
of adjacent pairs tells whether exact merging would leave each pair as it is, and only pre-tokens with a failing
pair are merged exactly.  A sequence is the exact encoding if and only if each of its adjacent pairs is.

Texts of Latin letters, digits, punctuation and plain white space are split by a pattern here; any other
text is split (and for the word-end vocabulary, encoded) by the tokenizers library, whose Unicode tables count.
"""

from __future__ import annotations

import json
import os
import re
import struct

import ahocorasick
import numpy as np

WORDS_KEPT = 200_000  # bounds the cache of a task; results don't depend on it

# The range of plain texts, and the classes of its characters by Unicode category.
_PLAIN = re.compile("[\t-\r -~¡-ſ]*")
_SPACES = "\t-\r "


def _class(kind: str) -> str:
    import unicodedata

    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == kind)


_L, _N = _class("L"), _class("N")
_CONTRACTED = "'(?:s|t|re|ve|m|ll|d)"
BYTE_SPLIT = re.compile(
    f"{_CONTRACTED}| ?[{_L}]+| ?[{_N}]+| ?[^{_SPACES}{_L}{_N}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
WORD_SPLIT = re.compile(f"[{_L}]+|[{_N}]|{_CONTRACTED}|[^{_SPACES}{_L}{_N}]+")


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free letter from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class _Library:
    """The tokenizers library's own object, made once per process."""

    _made: dict[str, object] = {}

    @classmethod
    def get(cls, path: str):
        if path not in cls._made:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            cls._made[path] = Tokenizer.from_file(path)
        return cls._made[path]


class WordEncoder:
    """Ids of the word-end vocabulary as little-endian unsigned 32-bit bytes."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        self.library = _Library.get(path)
        self.model = self.library.model
        self.stand_in = {b: c for b, c in enumerate(byte_alphabet())}
        self.known: dict[str, bytes] = {}

    @classmethod
    def get(cls, path: str) -> WordEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ready(self, words: set[str]) -> None:
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > WORDS_KEPT:
            self.known.clear()
            fresh = words
        tokenize, stand_in = self.model.tokenize, self.stand_in
        for w in fresh:
            ids = [t.id for t in tokenize(w.encode().decode("latin-1").translate(stand_in))]
            self.known[w] = struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        if "<|" in text or not _PLAIN.fullmatch(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        words = WORD_SPLIT.findall(text.lower())
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self.ready(set(words))
        return b"".join(map(self.known.__getitem__, words))


class ByteEncoder:
    """Speculating encoder of a byte-level BPE vocabulary; one per process and file."""

    _made: dict[str, ByteEncoder] = {}

    def __init__(self, path: str):
        self.library = _Library.get(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        letters = byte_alphabet()
        self.stand_in = dict(enumerate(letters))
        self.byte_of = {ord(c): chr(b) for b, c in enumerate(letters)}
        self.id_of = {t: i for t, i in vocab.items() if t not in self.special}
        self.token = {i: t for t, i in self.id_of.items()}
        self.raw = {i: t.translate(self.byte_of).encode("latin-1") for i, t in self.token.items()}
        self.raw |= {i: s.encode() for s, i in self.special.items()}
        self.search = ahocorasick.Automaton()
        for t, i in self.id_of.items():
            self.search.add_word(t, (i, len(t)))
        self.search.make_automaton()
        self.pairs = np.empty(0, dtype=np.int64)
        self.pair_holds = np.empty(0, dtype=bool)
        self.token_holds = np.full(max(vocab.values()) + 2, -1, dtype=np.int8)
        self.ids: dict[str, tuple[int, ...]] = {}
        self.shown: dict[str, str] = {}
        self.bytes_of: dict[str, bytes] = {}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @classmethod
    def get(cls, path: str) -> ByteEncoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merged(self, word: str) -> list[int]:
        """Exact merging of one pre-token: the adjacent pair of lowest rank first, until none is left."""
        return [t.id for t in self.library.model.tokenize(word)]

    def proposed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest matches of all words: ids, and the number of the word each belongs to."""
        line = "\n".join(words)  # no token holds a line feed
        found = [(i, end) for end, (i, _) in self.search.iter_long(line)]
        got = np.array(found, dtype=np.int64).reshape(-1, 2)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        return got[:, 0], np.searchsorted(ends, got[:, 1], side="right")

    def pair_table(self, keys: np.ndarray) -> np.ndarray:
        """Whether exact merging leaves each pair (first id * 2^20 + second id) as it is."""
        at = np.searchsorted(self.pairs, keys)
        held = at < len(self.pairs)
        held[held] = self.pairs[at[held]] == keys[held]
        fresh = keys[~held]
        if len(fresh):
            holds = np.array(
                [self.merged(self.token[k >> 20] + self.token[k & 0xFFFFF]) == [k >> 20, k & 0xFFFFF] for k in fresh.tolist()]
            )
            if len(self.pairs) > 4 * WORDS_KEPT:
                self.pairs, self.pair_holds = self.pairs[:0], self.pair_holds[:0]
                return self.pair_table(keys)
            every = np.concatenate([self.pairs, fresh])
            order = np.argsort(every)
            self.pairs, self.pair_holds = every[order], np.concatenate([self.pair_holds, holds])[order]
        return self.pair_holds[np.searchsorted(self.pairs, keys)]

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of pre-tokens given in stand-in letters."""
        ids, word = self.proposed(words)
        for i in np.unique(ids[self.token_holds[ids] < 0]).tolist():
            self.token_holds[i] = self.merged(self.token[i]) == [i]
        fails = np.zeros(len(words), dtype=bool)
        fails[word[self.token_holds[ids] == 0]] = True
        near = np.flatnonzero(word[1:] == word[:-1])
        keys = (ids[near] << 20) | ids[near + 1]
        unique, place = np.unique(keys, return_inverse=True)
        if len(unique):
            fails[word[near[~self.pair_table(unique)[place]]]] = True
        firsts = np.searchsorted(word, np.arange(len(words) + 1))
        flat = ids.tolist()
        return [
            tuple(self.merged(w)) if fails[k] else tuple(flat[firsts[k] : firsts[k + 1]]) for k, w in enumerate(words)
        ]

    def split(self, text: str) -> list[str]:
        """Pre-tokens, and special tokens as they stand; together they are the text."""
        out = []
        for part in self.special_split.split(text) if self.special_split and "<|" in text else [text]:
            if part in self.special:
                out.append(part)
            elif _PLAIN.fullmatch(part):
                out += BYTE_SPLIT.findall(part)
            else:
                for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part):
                    out.append(part[a:b])
        return out

    def ready(self, words: set[str]) -> None:
        """Put all of the pre-tokens into the caches."""
        fresh = words.difference(self.ids)
        if len(self.ids) + len(fresh) > WORDS_KEPT:
            for cache in (self.ids, self.shown, self.bytes_of):
                cache.clear()
            fresh = words
        plain = [w for w in fresh if w not in self.special]
        letters = [w.encode().decode("latin-1").translate(self.stand_in) for w in plain]
        found = list(zip(plain, self.encode_words(letters))) if plain else []
        for w, ids in [*found, *((w, (self.special[w],)) for w in fresh & self.special.keys())]:
            self.ids[w] = ids
            self.shown[w] = ",".join(map(str, ids))
            self.bytes_of[w] = b"".join(map(self.raw.__getitem__, ids))

    def encode(self, text: str) -> list[int]:
        words = self.split(text)
        self.ready(set(words))
        return [i for w in words for i in self.ids[w]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
