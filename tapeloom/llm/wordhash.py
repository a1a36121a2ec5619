"""Words of many texts at once, as numpy arrays over the bytes of an Arrow batch.

Hashes are 64-bit polynomials modulo 2**64 with a final mix. They select candidates; operators that must be
exact compare words or a second, independent hash afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Odd multipliers: bytes of a word, words of a first and of a second run hash.
BYTE_BASE, GRAM_BASE, SECOND_BASE = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0xD6E8FEB86659FD93)
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U)
    out[0] = 1
    return np.cumprod(out, dtype=U)


def inverse(base: np.uint64) -> np.uint64:
    return U(pow(int(base), -1, 1 << 64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with at most ``limit`` bytes, or one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """Words of consecutive texts: byte spans, the text each belongs to, and a hash."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        n = len(data)
        inside = is_word[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges], after[edges - 1] = False, False
        self.data, self.offsets = data, offsets
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each text; the last entry is the end
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)
        self.stop = self.first[1:][self.text] if len(self.text) else np.zeros(0, np.int64)  # end of its text, in words
        lengths = self.ends - self.starts
        if len(lengths):
            begin = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
            value = (data[inside].astype(U) + U(1)) * powers(BYTE_BASE, int(lengths.max()))[place]
            self.hash = mix(np.add.reduceat(value, begin))
        else:
            self.hash = np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.starts)


def words_of(column: pa.Array, is_word: np.ndarray, lower: np.ndarray | None = None, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, words) for each chunk of texts of a column."""
    data, offsets = text_buffers(column)
    for lo, hi in chunks(offsets, limit):
        part = data[offsets[lo] : offsets[hi]]
        yield lo, hi, Words(part if lower is None else lower[part], offsets[lo : hi + 1] - offsets[lo], is_word)


def grams(hashes: np.ndarray, n: int, base: np.uint64 = GRAM_BASE) -> np.ndarray:
    """Hash of every ``n`` consecutive values, in log2(n) passes."""
    if len(hashes) < n:
        return np.zeros(0, U)
    total, done, power, step, size = None, 0, hashes, base, 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if total is None:
                    total = power
                else:
                    m = min(len(total), len(power) - done)
                    total = total[:m] * step + power[done : done + m]
                done += size
            if done == n:
                return total[: len(hashes) - n + 1]
            power = power[:-size] * step + power[size:]
            step = step * step
            size *= 2


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every ``n`` consecutive values, in log2(n) passes."""
    size = 1
    while size * 2 <= n:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (n - size)], values[n - size :]) if n > size else values


#: Word characters of the contracts: all but space and 9-13; letters, digits and everything beyond ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
