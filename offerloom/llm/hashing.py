"""Rolling hashes over the bytes and words of many texts at once."""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
MASK = (1 << 64) - 1
#: Odd factors of the polynomial hashes; any odd values would do.
BYTE_FACTOR, WORD_FACTOR, LONG_FACTOR = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xAEF17502108EF2D9

#: Bytes that part words: space and tab to carriage return.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower case of A-Z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


#: A 64-bit value for each byte; separators count as nothing inside a word hash.
BYTE_VALUES = mix(np.arange(1, 257, dtype=U) * U(BYTE_FACTOR))


@functools.cache
def _powers(factor: int, size: int) -> np.ndarray:
    out = np.full(size, U(factor))
    out[:1] = 1
    return np.multiply.accumulate(out)


def powers(factor: int, n: int) -> np.ndarray:
    """factor ** 0, 1, ... modulo 2 ** 64, at least ``n`` of them."""
    return _powers(factor, 1 << max(12, int(n).bit_length()))


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and the word at which each text begins (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    begins = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, separator: np.ndarray = SEPARATOR) -> np.ndarray:
    """A 64-bit hash of each word."""
    if not len(begins):
        return np.zeros(0, U)
    first = begins[0]
    spans = np.diff(np.append(begins, len(data)))
    place = np.arange(len(data) - first) - np.repeat(begins - first, spans)
    values = BYTE_VALUES[data[first:]]
    values[separator[data[first:]]] = 0
    values *= powers(BYTE_FACTOR, int(spans.max()))[place]
    return mix(np.add.reduceat(values, begins - first) + (ends - begins).astype(U))


def window_hashes(values: np.ndarray, length: int, factor: int) -> np.ndarray:
    """A hash of each ``length`` neighbouring values (none if there are fewer), by prefix sums; texts are not parted here."""
    n = len(values)
    if n < length:
        return np.zeros(0, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(values * powers(factor, n)[:n], out=sums[1:])
    inverse = pow(factor, -1, 1 << 64)
    out = sums[length:] - sums[:-length]
    out *= powers(inverse, n)[: n - length + 1]
    return mix(out)


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest value (the first of equals) in each ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    # Smallest over spans of doubling length, then two spans that overlap cover the width.
    place = np.arange(len(values))
    span = 1
    while 2 * span <= width:
        left, right = place[:-span], place[span:]
        place = np.where(values[right] < values[left], right, left)
        span *= 2
    left, right = place[:n], place[width - span : width - span + n]
    return np.where(values[right] < values[left], right, left)
