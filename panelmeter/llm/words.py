"""Words, terms and shingles of whole texts as 64-bit hashes, over Arrow buffers.

Every function works on a string column of one Arrow batch and never builds a
Python string. A text is cut at separator bytes; a word's hash is a difference
of prefix sums of a polynomial over its bytes (modulo 2^64), mixed afterwards.
Buffers are walked in windows of WINDOW bytes that end between words, so working
memory does not grow with the length of a text; only a word's 16 bytes do.
Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from contextlib import suppress
from functools import cache, wraps

import numpy as np
import pyarrow as pa

WINDOW = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeded(*parts: int) -> np.uint64:
    """One constant from small integers."""
    x = np.array([0x243F6A8885A308D3], dtype=U)
    for p in parts:
        x = mix(x + np.array([p & (2**64 - 1)], dtype=U) * U(BASE))
    return x[0]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    inverse = pow(BASE, -1, 2**64)
    up, down = np.full(n, BASE, dtype=U), np.full(n, inverse, dtype=U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


class Alphabet:
    """Which bytes separate words, and the value of every other byte."""

    def __init__(self, separators: bytes, fold: bool = False):
        self.separates = np.zeros(256, dtype=bool)
        self.separates[list(separators)] = True
        folded = np.arange(256)
        if fold:
            folded[65:91] += 32
        self.value = mix(folded.astype(U) + seeded(7))


SPACES = bytes([32, *range(9, 14)])
#: whole words as written, cut at white space
PLAIN = Alphabet(SPACES)
#: lower-case words; every ASCII sign cuts, bytes beyond ASCII belong to a word
TERMS = Alphabet(bytes(b for b in range(128) if not chr(b).isalnum()), fold=True)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row limits in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    limits = np.frombuffer(column.buffers()[1], dtype=np.int64)[
        column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data or b"", dtype=np.uint8), limits


def _windows(data, limits, separates):
    """Row spans cut into pieces of about WINDOW bytes that end between words."""
    at, end = int(limits[0]), int(limits[-1])
    while at < end:
        stop = min(at + WINDOW, end)
        if stop < end:
            row = int(limits[np.searchsorted(limits, stop, "right") - 1])
            if row > at:
                stop = row
            else:
                cuts = np.flatnonzero(separates[data[at:stop]])
                if len(cuts):
                    stop = at + int(cuts[-1]) + 1
                else:                      # one word longer than a window
                    after = int(limits[np.searchsorted(limits, at, "right")])
                    while stop < after and not separates[data[stop]]:
                        stop = min(after, stop + 1 + int(np.argmax(np.append(
                            separates[data[stop + 1:stop + WINDOW]], True))))
        yield at, stop
        at = stop


def words(column: pa.Array, alphabet: Alphabet = PLAIN, prefixes: tuple[int, ...] = ()):
    """(row, hash, [hash of the first p bytes for each p in prefixes]) of every word in order.

    A negative p stands for the last -p bytes. A part as long as its word gives the
    word's own hash.
    """
    data, limits = buffers(column)
    rows, hashes, heads = [], [], [[] for _ in prefixes]
    for at, stop in _windows(data, limits, alphabet.separates):
        piece = data[at:stop]
        inside = ~alphabet.separates[piece]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = limits[np.searchsorted(limits, at, "left"):np.searchsorted(limits, stop, "right")] - at
        begin = cuts[(cuts > 0) & (cuts < len(piece))]
        first[begin] = inside[begin]
        last[begin - 1] = inside[begin - 1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        if not len(start):
            continue
        size = WINDOW if len(piece) <= WINDOW else 1 << int(len(piece) - 1).bit_length()
        up, down = _powers(size)
        sums = np.zeros(len(piece) + 1, dtype=U)
        np.cumsum(alphabet.value[piece] * up[:len(piece)], out=sums[1:])
        back = down[start]
        rows.append(np.searchsorted(limits, start + at, "right") - 1)
        hashes.append(mix((sums[end] - sums[start]) * back))
        for p, out in zip(prefixes, heads):
            if p > 0:
                out.append(mix((sums[np.minimum(end, start + p)] - sums[start]) * back))
            else:
                low = np.maximum(start, end + p)
                out.append(mix((sums[end] - sums[low]) * down[low]))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(rows, np.int64), join(hashes, U), [join(x, U) for x in heads]


def grams(row: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words inside a row."""
    if len(word) < n:
        return row[:0], word[:0]
    total = np.full(len(word) - n + 1, seeded(n), dtype=U)
    for k in range(n):
        total += mix(word[k:len(word) - n + 1 + k] + seeded(3, k))
    same = row[:len(total)] == row[n - 1:]
    return row[:len(total)][same], mix(total[same])


def shingles(row: np.ndarray, word: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Runs of n words in row order; a row with fewer words gives one run of all it has."""
    rows, out = grams(row, word, n)
    sizes = np.bincount(row, minlength=1) if len(row) else np.zeros(1, np.int64)
    for k in range(1, n):
        short = sizes[row] == k if len(row) else np.zeros(0, bool)
        if short.any():
            r, h = grams(row[short], word[short], k)
            rows, out = np.concatenate([rows, r]), np.concatenate([out, h])
    if (rows[1:] < rows[:-1]).any():
        order = np.argsort(rows, kind="stable")
        rows, out = rows[order], out[order]
    return rows, out


def distinct(row: np.ndarray, value: np.ndarray, n_rows: int):
    """Sorted distinct values of each row: (row, value, count); row must be ascending."""
    value = value.copy()
    limits = np.searchsorted(row, np.arange(n_rows + 1))
    for a, b in zip(limits[:-1], limits[1:]):
        value[a:b].sort()
    first = np.ones(len(value), dtype=bool)
    if len(value):
        first[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], value[at], np.diff(np.append(at, len(value)))


def fingerprints(row: np.ndarray, word: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words, equal for equal sequences."""
    limits = np.searchsorted(row, np.arange(n_rows + 1))
    place = np.arange(len(word), dtype=np.int64) - limits[row] if len(word) else word.astype(np.int64)
    out = []
    for seed in (11, 12):
        part = mix(word + mix(place.astype(U) * U(BASE) + seeded(seed)))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(part, dtype=U)])
        out.append(mix(sums[limits[1:]] - sums[limits[:-1]] + np.diff(limits).astype(U)))
    return out[0], out[1]


def frugal(run):
    """run, a function from Arrow batches to Arrow batches, that gives freed memory back to the
    system when its task ends: Python workers stay on beside those of later stages."""
    @wraps(run)
    def inner(it):
        try:
            yield from run(it)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):           # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)
    return inner


def batches(column: pa.Array, most: int = 1 << 20):
    """(start, stop) row spans holding about most bytes each, at least one row."""
    _, limits = buffers(column)
    at = 0
    while at < len(limits) - 1:
        stop = max(at + 1, int(np.searchsorted(limits, limits[at] + most, "right")) - 1)
        yield at, stop
        at = stop
