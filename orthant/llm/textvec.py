"""Vectorised text scanning: Arrow string columns as flat arrays, runs of a class of characters, and 64-bit hashes of every run.

A batch of texts is handled as one flat array of bytes or code points plus
document offsets, so the cost per character is a few numpy operations and no
Python object is made per word. A hash only groups runs: `distinct_runs`
compares what it groups, so its result is exact whatever collides.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of a run that are mixed eight at a time; longer runs go through BLAKE2b.
LONG = 64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def run_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run flat[start:end]; equal runs of one element type hash alike wherever they stand.

    Eight bytes a step are mixed into the hashes of all runs that go on, with
    the length as the seed; a polynomial would let structured runs collide.
    """
    unit = flat.itemsize
    raw = np.concatenate([np.ascontiguousarray(flat).view(np.uint8), np.zeros(8, np.uint8)])
    loads = np.lib.stride_tricks.as_strided(raw[:8].view(U), (len(raw) - 7,), (1,)).copy()  # the eight bytes from each on
    at, left = starts * unit, (ends - starts) * unit
    h = mix(left.astype(U) * U(0xD6E8FEB86659FD93) + U(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(left > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[at[i] : at[i] + left[i]].tobytes(), digest_size=8).digest(), "little")
    live = np.flatnonzero((left > 0) & (left <= LONG))
    at, left = at[live], left[live]
    while len(live):
        keep = np.minimum(left, 8).astype(U) * U(8)
        h[live] = mix(h[live] ^ (loads[at] & (~U(0) >> (U(64) - keep))))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return h


def differing(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Places of the runs that are not equal to the run at the place `like` names for each."""
    sizes = ends - starts
    wrong = sizes != sizes[like]
    rows = np.flatnonzero(~wrong & (like != np.arange(len(like))) & (sizes > 0))
    # up to a few million characters at a time
    cuts = np.cumsum(sizes[rows])
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(cuts, (cuts[lo - 1] if lo else 0) + (1 << 21), "right")))
        part = rows[lo:hi]
        size = sizes[part]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum()))
        unequal = flat[np.repeat(starts[part] - first, size) + step] != flat[np.repeat(starts[like[part]] - first, size) + step]
        if unequal.any():
            wrong[part[np.logical_or.reduceat(unequal, first)]] = True
        lo = hi
    return np.flatnonzero(wrong)


def distinct_runs(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct run, and for every run the number of its equal among these."""
    _, first, back = np.unique(run_hashes(flat, starts, ends), return_index=True, return_inverse=True)
    odd = differing(flat, starts, ends, first[back])
    if len(odd):  # a collision of hashes: these few are told apart by their content
        names: dict[bytes, int] = {}
        more = []
        for i in odd.tolist():
            name = flat[starts[i] : ends[i]].tobytes()
            if name not in names:
                names[name] = len(first) + len(more)
                more.append(i)
            back[i] = names[name]
        first = np.concatenate([first, np.array(more)])
    return first, back


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that don't cross a document's border."""
    n = len(inside)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    begin[first] = inside[first]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    end[last] = inside[last]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and its document offsets, without copies where Arrow allows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offs else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of about `most` bytes each, so that working arrays stay small."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts (null: empty) as one array, and the document offsets."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), offsets


LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0

#: The characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def char_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of each code point."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            kinds[c] = LETTER
        elif kind == "N":
            kinds[c] = NUMBER
    kinds[WHITE_SPACE] = SPACE
    return kinds


@lru_cache(1)
def byte_tables() -> dict[str, np.ndarray]:
    """By byte: ASCII lower case, not a blank (0x20, 0x09-0x0D), part of a word, a capital, a symbol."""
    b = np.arange(256)
    capital = (b >= 65) & (b <= 90)
    lower = np.where(capital, b + 32, b).astype(np.uint8)
    solid = ~((b == 0x20) | ((b >= 9) & (b <= 13)))
    word = capital | ((b >= 97) & (b <= 122)) | (b >= 128)
    digit = (b >= 48) & (b <= 57)
    return {"lower": lower, "solid": solid, "word": word, "capital": capital, "symbol": solid & ~word & ~digit & (b > 32) & (b < 127)}
