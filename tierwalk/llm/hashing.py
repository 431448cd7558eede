"""64-bit hashes of the words of whole Arrow batches, without a step for each word.

A batch's bytes are one array. Every byte has a random 64-bit value; a word's hash is the polynomial of its
bytes' values in an odd number, taken as a difference of prefix sums and shifted back to the word's start,
and then mixed. All of it is arithmetic modulo 2**64, so equal words have equal hashes wherever they stand.
Memory is about 40 bytes for each byte of text in hand; texts go in pieces of PIECE bytes, cut between
texts only, so a single very long text is the largest piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once, if no single text is longer.
PIECE = 1 << 18
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)
_values = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the odd number and of its inverse; kept for the next call."""
    for k, base in enumerate((_ODD, _BACK)):
        while len(_powers[k]) < n:
            p = _powers[k]
            step = np.uint64(pow(base, len(p), 1 << 64))
            _powers[k] = np.concatenate((p, p * step))
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Alphabet:
    """Which bytes are in words, and what they count as: `parts` is a table of 256, True inside words; A-Z count as a-z."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts
        low = np.arange(256)
        low[65:91] += 32
        self.value = _values[low]


def _ascii_space() -> np.ndarray:
    t = np.ones(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = False
    return t


def _letters() -> np.ndarray:
    t = np.zeros(256, bool)
    t[0x30:0x3A] = t[0x61:0x7B] = t[0x41:0x5B] = t[0x80:] = True
    return t


#: Words between ASCII white space; words of ASCII letters, digits and whatever lies beyond ASCII.
SPACED, LETTERS = Alphabet(_ascii_space()), Alphabet(_letters())


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and where each row starts (one more than rows); nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes each, or of one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, offsets: np.ndarray, alphabet: Alphabet) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, start, end of every word of these texts, and for each text the number of its first word (one more than texts)."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = alphabet.parts[data]
    first = np.diff(inside) == 1
    last = np.diff(inside) == -1
    # a text's start cuts a word that would run on from the text before
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    if len(cut):
        run = cut[(inside[cut] == 1) & (inside[cut + 1] == 1)]
        first[run] = True
        last[run] = True
    start, end = np.flatnonzero(first), np.flatnonzero(last)
    up, back = _powers_to(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(alphabet.value[data] * up[:n], out=total[1:])
    h = mixed((total[end] - total[start]) * back[start])
    return h, start, end, np.searchsorted(start, offsets)


def shingles(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of every text in order, with repeats, and where each text's start (one more than texts).

    A text of fewer words has one shingle, of all its words; one without words none.
    """
    count = np.diff(bounds)
    k = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate(([0], np.cumsum(k)))
    out = np.empty(at[-1], np.uint64)
    full = count >= n
    if full.any():
        g = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            g = g * np.uint64(_ODD) + h[j : j + len(g)]
        # a window is whole where it doesn't reach into the next text
        whole = np.zeros(len(h) + 1, np.int8)
        np.add.at(whole, bounds[:-1][full], 1)
        np.add.at(whole, bounds[1:][full] - n + 1, -1)
        place = np.zeros(at[-1] + 1, np.int8)
        np.add.at(place, at[:-1][full], 1)
        np.add.at(place, at[1:][full], -1)
        out[np.cumsum(place[:-1]) > 0] = mixed(g)[np.cumsum(whole[: len(g)]) > 0]
    for r in np.flatnonzero((count > 0) & ~full):
        total = np.uint64(count[r]) * np.uint64(0x2545F4914F6CDD1D)
        for x in h[bounds[r] : bounds[r + 1]]:
            total = (total ^ x) * np.uint64(_BACK)
        out[at[r]] = mixed(np.array([total], np.uint64))[0]
    return out, at


def sets(column: pa.Array, n: int, alphabet: Alphabet = SPACED) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For pieces of a text column: first row, last row (not included), where each row's set starts, and the sorted distinct shingles of all rows."""
    data, offsets = as_bytes(column)
    for a, b in pieces(offsets):
        piece = data[offsets[a] : offsets[b]]
        with np.errstate(over="ignore"):
            h, _, _, bounds = words(piece, offsets[a : b + 1] - offsets[a], alphabet)
            g, at = shingles(h, bounds, n)
        new = np.ones(len(g), bool)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            g[i:j].sort()
        new[1:] = g[1:] != g[:-1]
        new[at[:-1][at[:-1] < len(g)]] = True
        yield a, b, np.concatenate(([0], np.cumsum(new)))[at], g[new]


class Table:
    """Numbers of known hashes: open addressing in numpy; 0 stands for a hash that isn't there."""

    def __init__(self, hashes: np.ndarray):
        self.log = max(4, int(4 * max(1, len(hashes)) - 1).bit_length())
        self.keys = np.zeros(1 << self.log, np.uint64)
        self.numbers = np.zeros(1 << self.log, np.int32)
        todo, step = np.arange(len(hashes)), np.uint64(0)
        while len(todo):
            at = self._slot(hashes[todo], step)
            free = self.numbers[at] == 0
            self.numbers[at[free]] = todo[free] + 1  # the last of several wins
            mine = self.numbers[at] == todo + 1
            self.keys[at[mine]] = hashes[todo[mine]]
            todo, step = todo[~mine], step + np.uint64(1)
        self.steps = int(step)

    def _slot(self, h: np.ndarray, step: np.uint64) -> np.ndarray:
        return (((h >> np.uint64(64 - self.log)) + step) & np.uint64((1 << self.log) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """1 + the place of each hash, or 0."""
        at = self._slot(h, np.uint64(0))
        out = self.numbers[at]
        wrong = np.flatnonzero((out > 0) & (self.keys[at] != h))
        for step in range(1, self.steps):
            if not len(wrong):
                break
            at = self._slot(h[wrong], np.uint64(step))
            out[wrong] = self.numbers[at]
            wrong = wrong[(out[wrong] > 0) & (self.keys[at] != h[wrong])]
        out[wrong] = 0
        return out
