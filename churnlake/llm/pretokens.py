"""Pre-tokenisation without regular expressions.

Code points become classes through one array, classes become symbols that also tell what follows, and a small
automaton reads the symbols.  A symbol is a transition function on the automaton's states.  Composition of such
functions is associative, so the states before all characters come from a blocked prefix scan over function numbers
with a composition table, not from a loop over characters.  A piece starts where state and symbol say so.

The pieces are the matches of ``public_tokenizers.PATTERN``: contractions after anything but a space or a symbol; runs
of letters, digits or other characters with one leading space; white space, whose last character is left to a text
that follows.
"""

from __future__ import annotations

import functools

import numpy as np

WINDOW = 1 << 20  # characters scanned at once; the state is carried on, so that results don't depend on it

LETTER, NUMBER, OTHER, SHORT, LONG, JOIN, LAST, BLANK, END = range(9)
_APOSTROPHE, _SPACE, _WHITE = 3, 4, 5  # classes beside LETTER, NUMBER and OTHER
FRESH, LETTERS, NUMBERS, OTHERS, JOINED, BLANKS, ONE, TWO = range(8)
STATES = 8


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of each code point by the Unicode tables that the tiktoken library itself uses."""
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for number, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (_WHITE, r"\s")):
        found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        members = bytes(found.encode_ordinary(every)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), dtype="<u4")] = number
    table[ord("'")], table[ord(" ")] = _APOSTROPHE, _SPACE
    return table


def _step(state: int, symbol: int) -> tuple[bool, int]:
    """Whether a piece starts at a character with this symbol, and the state after it."""
    if symbol in (LETTER, NUMBER, OTHER):
        if state in (ONE, TWO):  # inside a contraction
            return False, FRESH if state == ONE else ONE
        run = (LETTERS, NUMBERS, OTHERS)[symbol]
        return state not in (run, JOINED), run
    if symbol in (SHORT, LONG):
        if state in (OTHERS, JOINED):  # the apostrophe belongs to a run, and no contraction starts
            return False, OTHERS
        return True, ONE if symbol == SHORT else TWO
    if symbol == BLANK:
        return state != BLANKS, BLANKS
    return True, JOINED if symbol == JOIN else FRESH


@functools.cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Numbers of the symbols' functions, the composition table, each function's values, the starts table, identity."""
    base = [tuple(_step(s, c)[1] for s in range(STATES)) for c in range(9)]
    known = {tuple(range(STATES)): 0}
    queue = list(known)
    for f in queue:
        for g in base:
            both = tuple(g[s] for s in f)
            if both not in known:
                known[both] = len(known)
                queue.append(both)
    values = np.array(list(known), dtype=np.int64)
    compose = np.array([[known[tuple(values[b][values[a]])] for b in range(len(known))] for a in range(len(known))])
    starts = np.array([[_step(s, c)[0] for c in range(9)] for s in range(STATES)])
    return np.array([known[f] for f in base]), compose, values, starts, 0


def states_before(functions: np.ndarray, first: int) -> tuple[np.ndarray, int]:
    """The state before each function of a sequence applies, and the one after the last, by an associative scan."""
    _, compose, values, _, identity = _monoid()
    n, flat, size = len(functions), compose.ravel(), len(compose)
    if n < 128:
        out, state = np.empty(n, dtype=np.int64), first
        for i, f in enumerate(functions.tolist()):
            out[i] = state
            state = values[f, state]
        return out, int(state)
    width = max(2, int(np.sqrt(n) / 4))
    rows = -(-n // width)
    padded = np.full(rows * width, identity, dtype=np.int64)
    padded[:n] = functions
    # Row j holds the composition of the first j functions of every block.
    held = np.empty((width + 1, rows), dtype=np.int64)
    held[0] = identity
    columns = np.ascontiguousarray(padded.reshape(rows, width).T)
    for j in range(width):
        np.take(flat, held[j] * size + columns[j], out=held[j + 1])
    entry, last = states_before(held[width], first)
    inside = values.ravel()[held[:width] * STATES + entry]
    return inside.T.ravel()[:n], last


def _symbols(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Symbols of all but the last two characters."""
    kind, after = kinds[:-2], kinds[1:-1]
    second, third = points[1:-1], points[2:]
    symbol = kind.copy()
    white = (kind == _SPACE) | (kind == _WHITE)
    last = white & (after != _SPACE) & (after != _WHITE) & (after != END)
    symbol[white] = BLANK
    symbol[last] = np.where(kind[last] == _SPACE, JOIN, LAST)
    quotes = np.flatnonzero(kind == _APOSTROPHE)
    a, b = second[quotes], third[quotes]
    short = np.isin(a, [ord(c) for c in "stmd"])
    long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    symbol[quotes] = np.where(short, SHORT, np.where(long, LONG, OTHER))
    return symbol


def pieces(texts: list[str], classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by one character each, as UTF-8 bytes; the byte at which every piece starts; and the number of
    each text's first piece.  The joining characters are the last pieces of their texts."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer((joined + "\n\n").encode("utf-32-le", "replace"), dtype="<u4")
    kinds = classes[points]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kinds[ends] = END
    kinds[-2:] = END
    numbers, _, _, rule, _ = _monoid()
    state, found = FRESH, []
    for at in range(0, len(points) - 2, WINDOW):
        to = min(at + WINDOW, len(points) - 2)
        symbol = _symbols(points[at : to + 2], kinds[at : to + 2])
        before, state = states_before(numbers[symbol], state)
        found.append(at + np.flatnonzero(rule[before, symbol]))
    starts = np.concatenate(found)
    size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    place = np.cumsum(size, dtype=np.int64) - size
    first = np.searchsorted(starts, np.append(0, ends[:-1] + 1))
    return np.frombuffer(joined.encode("utf-8", "replace"), dtype=np.uint8), place[starts], first
