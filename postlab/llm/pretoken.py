"""Split texts into the pieces of the byte-level BPE pattern without a regular expression.

The pattern is a finite automaton over classes of code points. Every symbol is a
function from state to state; composing functions is associative, so the states
of a whole batch come from a blocked prefix scan: compose within all blocks at
once, scan the block totals, then apply each block's entry state. The functions
that compositions can reach are few and numbered, and composing is a table
look-up on those numbers.
"""

from __future__ import annotations

import numpy as np

# Classes of code points; END is the mark between two texts.
OTHER, LETTER, NUMBER, SPACE, BLANK, END = range(6)
END_POINT = 0x110000

# Symbols: a code point's class together with what the rule must know of its
# neighbours. A white-space run gives all but its last member to one piece, and
# the last one, if a space, to the piece that follows.
(S_OTHER, S_LETTER, S_NUMBER, S_SHORT, S_LONG, S_INNER, S_PREFIX, S_SINGLE,
 S_END) = range(9)
SYMBOLS = 9

# States: what the piece being read may still take.
(FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, PREFIXED, ONE_LEFT, TWO_LEFT) = range(8)
STATES = 8

SHORT_SUFFIXES = "stmd"  # 's 't 'm 'd
LONG_SUFFIXES = ("re", "ve", "ll")
BLOCKS = 4096


def class_table() -> bytes:
    """One class per code point, by the character classes of the tokenizer library itself.

    Asking the library keeps its Unicode version, which is newer than Python's.
    """
    import tiktoken

    points = [c for c in range(END_POINT) if not 0xD800 <= c < 0xE000]
    everything = "".join(map(chr, points))
    table = np.zeros(END_POINT + 1, np.uint8)
    for pattern, value in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        finder = tiktoken.Encoding(
            "class", pat_str=pattern, special_tokens={},
            mergeable_ranks={bytes([i]): i for i in range(256)})
        found = finder.decode_bytes(finder.encode_ordinary(everything)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), np.uint32)] = value
    table[0x20] = SPACE
    table[END_POINT] = END
    return table.tobytes()


def step(state: int, symbol: int) -> tuple[bool, int]:
    """Whether a piece begins before this symbol, and the state after it."""
    if symbol == S_END:
        return True, FRESH
    if state == TWO_LEFT:
        return False, ONE_LEFT
    if state == ONE_LEFT:
        return False, FRESH
    if symbol == S_LETTER:
        return state not in (LETTERS, PREFIXED), LETTERS
    if symbol == S_NUMBER:
        return state not in (NUMBERS, PREFIXED), NUMBERS
    if symbol in (S_OTHER, S_SHORT, S_LONG):
        if state in (OTHERS, PREFIXED):
            return False, OTHERS
        return True, {S_OTHER: OTHERS, S_SHORT: ONE_LEFT, S_LONG: TWO_LEFT}[symbol]
    if symbol == S_INNER:
        return state != BLANKS, BLANKS
    return True, PREFIXED if symbol == S_PREFIX else FRESH


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions that symbols compose to: their table, composition, and symbols' numbers."""
    identity = tuple(range(STATES))
    generators = [tuple(step(q, s)[1] for q in range(STATES)) for s in range(SYMBOLS)]
    functions = {identity: 0}
    todo = [identity]
    for f in todo:
        for g in generators:
            h = tuple(g[q] for q in f)
            if h not in functions:
                functions[h] = len(functions)
                todo.append(h)
    act = np.array(todo, np.uint8)
    compose = np.array([[functions[tuple(g[q] for q in f)] for g in todo] for f in todo])
    return act, compose.astype(np.uint16), np.array([functions[g] for g in generators], np.uint16)


ACT, COMPOSE, ELEMENT = _monoid()
WIDTH = np.uint16(len(ACT))
FLAT_COMPOSE = (COMPOSE * 1).reshape(-1)
BEGINS = np.array([[step(q, s)[0] for s in range(SYMBOLS)] for q in range(STATES)])


def symbols(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    kind = classes[points]
    following = np.append(kind[1:], np.uint8(END))
    out = np.array([S_OTHER, S_LETTER, S_NUMBER, S_INNER, S_INNER, S_END], np.uint8)[kind]
    last = ((kind == SPACE) | (kind == BLANK)) & (following <= NUMBER)
    out[last] = np.where(kind[last] == SPACE, S_PREFIX, S_SINGLE)
    quote = np.flatnonzero(points == ord("'"))
    padded = np.append(points, [END_POINT, END_POINT]).astype(np.uint32)
    one, two = padded[quote + 1], padded[quote + 2]
    out[quote[np.isin(one, [ord(c) for c in SHORT_SUFFIXES])]] = S_SHORT
    for a, b in LONG_SUFFIXES:
        out[quote[(one == ord(a)) & (two == ord(b))]] = S_LONG
    return out


def states_before(symbol: np.ndarray) -> np.ndarray:
    """The state in front of every symbol, by a blocked associative scan."""
    n = len(symbol)
    length = max(1, -(-n // BLOCKS))
    blocks = -(-n // length)
    element = np.zeros(blocks * length, np.uint16)  # 0 is the identity
    element[:n] = ELEMENT[symbol]
    columns = np.ascontiguousarray(element.reshape(blocks, length).T)
    running = columns[0]
    inner = np.empty_like(columns)
    inner[0] = running
    for j in range(1, length):
        running = FLAT_COMPOSE[running * WIDTH + columns[j]]
        inner[j] = running
    totals, gap = running.copy(), 1
    while gap < blocks:
        totals[gap:] = FLAT_COMPOSE[totals[:-gap] * WIDTH + totals[gap:]]
        gap *= 2
    entry = np.full(blocks, FRESH, np.uint8)
    entry[1:] = ACT[totals[:-1], FRESH]
    after = ACT[inner, entry].T.reshape(-1)[:n]
    before = np.empty(n, np.uint8)
    before[:1] = FRESH
    before[1:] = after[:-1]
    return before


def piece_bounds(points: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last positions of all pieces; END marks belong to none."""
    symbol = symbols(points, classes)
    first = np.flatnonzero(BEGINS[states_before(symbol), symbol])
    last = np.append(first[1:], len(points))
    real = symbol[first] != S_END
    return first[real], last[real]
