"""Whole Arrow batches of texts as one byte array: words, their hashes and n-gram hashes, without a loop per word.

A batch is cut into slices of a few megabytes (a longer text is a slice of its own), so memory stays bounded.
Hashes are polynomials modulo 2**64, read off prefix sums, and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
SLICE_BYTES = 1 << 20


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, grown when a longer text needs them."""

    def __init__(self, base: int):
        self.base, self.inverse, self.n = base, pow(base, -1, 1 << 64), 0

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 16)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([np.ones(1, U), np.cumprod(np.full(self.n, b, U), dtype=U)]) for b in (self.base, self.inverse))
        return self.up, self.down


_bytes, _words = _Powers(_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


def _table(keep) -> np.ndarray:
    return np.array([keep(b) for b in range(256)], dtype=bool)


#: Bytes that separate words: white space only, or everything but ASCII letters, digits and non-ASCII bytes.
SPACE = _table(lambda b: b == 32 or 9 <= b <= 13)
NOT_ALNUM = _table(lambda b: b < 128 and not chr(b).isalnum())


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of the batch with the bytes of ``column`` and, per row, where its text starts (one more at the end). Null: empty."""
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with ASCII and Latin-1 capital letters made small."""
    out = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
    second = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)) + 1
    out[second] += 32
    return out


class Words:
    """The words of a slice. ``start``, ``end``: byte positions; ``doc``: where each row's words begin, one more at the end."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE):
        inside = ~separators[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = inside[heads]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = inside[offsets[1:][offsets[:-1] < offsets[1:]] - 1]
        self.data = data
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.start, offsets)
        self.sums = None

    def hashes(self, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``most`` bytes."""
        up, down = _bytes.get(len(self.data) + 1)
        with np.errstate(over="ignore"):
            if self.sums is None:
                self.sums = np.concatenate([np.zeros(1, U), np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], dtype=U)])
            end = self.end if most is None else np.minimum(self.end, self.start + most)
            return mix((self.sums[end] - self.sums[self.start]) * down[self.start])


class Grams:
    """Hashes of runs of values (word hashes), any length, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        up, self.down = _words.get(len(values) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, U), np.cumsum(values * up[: len(values)], dtype=U)])

    def at(self, start: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[start + n] - self.sums[start]) * self.down[start])


def run_starts(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a run of ``n`` words of one row begins, and the row of each."""
    counts = np.maximum(np.diff(doc) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + doc[:-1][row], row


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """The least of ``values[i : i + n]``; the last ``n - 1`` places are cut off."""
    if len(values) < n:
        return values[:0]
    out, size = values, 1
    while 2 * size <= n:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(values) - n + 1], out[n - size :][: len(values) - n + 1])
