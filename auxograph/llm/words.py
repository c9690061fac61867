"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

All word rules here are rules on bytes: blanks and ASCII letters are single bytes, and every byte of
a longer character is 0x80 or above, so cutting bytes and cutting characters give the same words.
A word's hash is a polynomial over random 64-bit values of its bytes, taken from prefix sums modulo
2 ** 64, and mixed; equal words have equal hashes, and different ones differ but for a chance of
about 2 ** -64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on together (a longer text is worked on alone).
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
_LINE = np.ones(256, bool)
_LINE[0x0A] = False
#: Which bytes belong to a word: all but blanks; or digits, ASCII letters and all beyond ASCII; or, for lines, all but line feeds.
WORD_BYTES = {"not_blank": _NOT_BLANK, "alnum": _ALNUM, "line": _LINE}

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            all_of = np.full(max(n, CHUNK_BYTES), base)
            all_of[0] = 1
            _powers[i] = np.cumprod(all_of)
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def byte_values(seed: int, lower: bool) -> np.ndarray:
    """A random 64-bit value for each byte; with ``lower``, A-Z have those of a-z."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(2 * seed + 1) + np.uint64(seed))
    if lower:
        values[0x41:0x5B] = values[0x61:0x7B]
    return values


class Words:
    """The words of consecutive texts: byte ranges, and for each text the range of its words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rule: str):
        """``data``: the texts' bytes; ``offsets``: where each begins, and the end."""
        self.data, self.offsets = data, offsets
        inside = WORD_BYTES[rule][data]
        before, after = np.zeros(len(data), bool), np.zeros(len(data), bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        bounds = offsets[(offsets > 0) & (offsets < len(data))]
        before[bounds] = False
        after[bounds - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.of = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.of)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        power, inverse = _tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(byte_values(seed, lower)[self.data] * power[: len(self.data)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])


def windows(hashes: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """A hash of each run of ``k`` values; the last k - 1 starts have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * seed)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * factor + hashes[j : j + n]
    return mixed(total)


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges (a, b) of texts with their bytes and offsets: whole texts, together about ``most`` bytes."""
    if not len(column):
        return
    data, offsets = texts(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b
