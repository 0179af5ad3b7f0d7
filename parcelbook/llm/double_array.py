"""Double-array tries over rows of digits, built and walked in numpy."""

from __future__ import annotations

import numpy as np

#: Digits of a word's code; a state's children lie within so many places of its base.
RADIX_BITS = 6
WINDOW, NONE = 1024, -(1 << 30)


def digits_of(words: np.ndarray, digits: int) -> np.ndarray:
    """Each code as ``digits`` digits, high ones first; 0 digits: as many as the largest code needs."""
    digits = digits or max(1, -(-int(words.max(initial=1)).bit_length() // RADIX_BITS))
    shifts = np.arange(digits - 1, -1, -1) * RADIX_BITS
    return ((words[:, :, None] >> shifts) & ((1 << RADIX_BITS) - 1)).reshape(len(words), -1)


class _Places:
    """Which places are taken; the arrays grow as states are placed."""

    def __init__(self) -> None:
        self.used = np.zeros(1 << 14, bool)
        self.used[0] = True
        self.low = self.tail = 1

    def room(self, upto: int) -> None:
        if upto >= len(self.used):
            self.used = np.concatenate((self.used, np.zeros(max(len(self.used), upto + 1 - len(self.used)), bool)))

    def fit(self, digits: np.ndarray) -> int:
        """A base whose places are free for all digits: the first from ``low`` on, or behind all that are taken."""
        self.room(max(self.low + WINDOW, self.tail) + (2 << RADIX_BITS))
        free = self.low + np.flatnonzero(~self.used[self.low : self.low + WINDOW])
        base = free - digits[0]
        good = ~self.used[base[:, None] + digits].any(axis=1)
        at = int(good.argmax()) if len(good) else 0
        found = int(base[at]) if len(good) and good[at] else self.tail - int(digits[0])
        self.used[found + digits] = True
        self.tail = max(self.tail, found + int(digits[-1]) + 1)
        if len(free) < WINDOW // 16:
            self.low += WINDOW // 2
        return found


def build(rows: np.ndarray) -> np.ndarray:
    """(3, places): base, parent and accepted row of each place, for sorted distinct rows of digits.

    Place 0 is the root. A child under digit d of state s is place base[s] + d, and it is
    there if its parent is s. States of a level are placed by number of children, the
    largest first; those with one child fill the gaps.
    """
    places = _Places()
    n, depth = rows.shape
    base_of: list[tuple[np.ndarray, np.ndarray]] = []
    parent_of: list[tuple[np.ndarray, np.ndarray]] = []
    state = np.zeros(n, np.int64)  # place of each row's prefix
    fresh = np.zeros(n, bool)
    fresh[:1] = True
    for level in range(depth):
        top = np.flatnonzero(fresh)  # first rows of this level's states
        fresh[1:] |= rows[1:, level] != rows[:-1, level]
        child = np.flatnonzero(fresh)
        owner = np.searchsorted(top, child, "right") - 1
        many = np.bincount(owner, minlength=len(top))
        start = np.concatenate(([0], np.cumsum(many)))[:-1]
        digit = rows[child, level]
        bases = np.zeros(len(top), np.int64)
        for s in np.argsort(-many, kind="stable"):
            if many[s] < 2:
                break
            bases[s] = places.fit(digit[start[s] : start[s] + many[s]])
        single = np.flatnonzero(many == 1)
        if len(single):
            places.room(int(places.used.sum()) + len(single) + 1)
            free = np.flatnonzero(~places.used)[: len(single)]
            bases[single] = free - digit[start[single]]
            places.used[free] = True
            places.tail = max(places.tail, int(free[-1]) + 1)
        at = bases[owner] + digit
        base_of.append((state[top], bases))
        parent_of.append((at, state[top][owner]))
        state = np.repeat(at, np.diff(np.append(child, n)))
    size = int(np.flatnonzero(places.used)[-1]) + 1
    out = np.full((3, size), -1, np.int32)
    out[0] = NONE
    for where, value in base_of:
        out[0, where] = value
    for where, value in parent_of:
        out[1, where] = value
    out[2, state] = np.arange(n)
    return out


def descend(trie: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The accepted row of each row of digits, or -1; all rows go down a level at a time."""
    base, parent, accept = trie
    out = np.full(len(rows), -1, np.int64)
    live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    for level in range(rows.shape[1]):
        to = base[state].astype(np.int64) + rows[live, level]
        inside = (to >= 0) & (to < len(base))
        inside[inside] = parent[to[inside]] == state[inside]
        live, state = live[inside], to[inside]
    out[live] = accept[state]
    return out
