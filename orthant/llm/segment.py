"""Vectorised pre-tokenisation: the pieces that two public split patterns give, found without a regular expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np

from .textvec import LETTER, NUMBER, OTHER, SPACE, char_classes, distinct_runs

#: Class of characters that libraries may class differently: not assigned here, or letters and numbers of the supplementary planes.
UNSURE = 4


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = char_classes().copy()
    for c in range(0x110000):
        if unicodedata.category(chr(c)) == "Cn":
            kinds[c] = UNSURE
    high = kinds[0x10000:]
    high[(high == LETTER) | (high == NUMBER)] = UNSURE
    return kinds


def unsure(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold a character of the class UNSURE."""
    bad = np.flatnonzero(_classes()[points] == UNSURE)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, bad, "right") - 1] = True
    return out


def pieces(points: np.ndarray, offsets: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces, in order.

    spaces: as byte-level vocabularies split, with one blank before a piece
    kept in it and runs of digits whole. Otherwise white space is dropped and
    each digit stands alone. Either way 's 't 're 've 'm 'll 'd are pieces
    where an apostrophe begins one.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    kinds = _classes()[points]
    kinds[kinds == UNSURE] = OTHER
    border = np.zeros(n + 3, bool)  # a document begins here
    border[offsets] = True
    start = border[: n + 1].copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    if spaces:
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~border[1:n])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
    else:
        start[:n][kinds == NUMBER] = True
    quote = np.flatnonzero((points[:-1] == 39) & start[: n - 1] & ~border[1:n] & (kinds[1:] == LETTER))
    if len(quote):
        after = lambda k: np.where(quote + k < n, points[np.minimum(quote + k, n - 1)], 0)
        one, two = after(1), np.where(border[quote + 2], 0, after(2))
        short = np.isin(one, [ord(c) for c in "stmd"])
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((short, 1), (pair & ~short, 2)):
            start[quote[hit] + 1] = False
            start[quote[hit] + 1 + size] = True
    at = np.flatnonzero(start[:n])
    ends = np.concatenate([at[1:], [n]])
    if not spaces:
        solid = kinds[at] != SPACE
        at, ends = at[solid], ends[solid]
    return at, ends


class IdMemo:
    """Ids of pieces, found once for each distinct piece: kept by the piece itself, so that no other piece can take its ids.

    find: the ids of each of a list of pieces. Beyond `most` pieces, or that
    many times 16 characters, all is forgotten and found anew.
    """

    def __init__(self, find: Callable[[list[str]], list[list[int]]], most: int) -> None:
        self.find, self.most = find, most
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.characters = 0
        self.ids, self.used = np.empty(1 << 16, np.int32), 0
        self.first, self.size = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)

    def _add(self, names: list[str]) -> None:
        found = self.find(names)
        sizes = np.array([len(x) for x in found], np.int64)
        new, slot = np.array([i for x in found for i in x], np.int32), len(self.at)
        while self.used + len(new) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while slot + len(names) > len(self.first):
            self.first, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.first, self.size))
        self.ids[self.used : self.used + len(new)] = new
        self.first[slot : slot + len(names)] = self.used + np.cumsum(sizes) - sizes
        self.size[slot : slot + len(names)] = sizes
        self.used += len(new)
        self.characters += sum(map(len, names))
        self.at.update(zip(names, range(slot, slot + len(names)), strict=True))

    def __call__(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and where each piece's begin there (and the last one's end)."""
        first, back = distinct_runs(points, starts, ends)
        whole = points.tobytes().decode("utf-32-le")
        names = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        if len(self.at) > self.most or self.characters > 16 * self.most:
            self.forget()
        fresh = [n for n in names if n not in self.at]
        if fresh:
            self._add(fresh)
        slot = np.array([self.at[n] for n in names], np.int64)[back]
        sizes = self.size[slot]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(self.first[slot] - total[:-1], sizes) + np.arange(total[-1])], total
