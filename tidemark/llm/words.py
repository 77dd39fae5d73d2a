"""Words and word hashes of many documents at once: numpy over the UTF-8 buffers of an Arrow column.

A column of texts is cut into blocks of a few MB. Within a block the bytes of all documents lie in one array; words
are found with one table lookup per byte, and a word's hash is a difference of prefix sums. No step loops over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD6E8FEB86659FD93
_WORD_BASE = 0xA0761D6478BD642F


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)


class _Powers:
    """Powers of an odd base modulo 2^64 and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            self.up, self.down = self._row(self.base, n + 1), self._row(self.inverse, n + 1)
        return self.up, self.down

    @staticmethod
    def _row(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_bytes_up, _words_up = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def separator_table(separators: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(separators)] = True
    return table


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return np.where(upper, data + np.uint8(32), data)


class Words:
    """The words of a block: byte ranges ``starts:ends`` in ``data``; document j has words ``first[j]:first[j + 1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = ~separators[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        if not len(data):
            before = after = inside
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word; equal words have equal hashes in every block and process."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        up, down = _bytes_up.to(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE_CODE[self.data] * up[: len(self.data)], out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * down[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _ODD)


class Grams:
    """Hashes of runs of consecutive words, from the words' hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.n = len(hashes)
        up, self.down = _words_up.to(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(hashes * up[: self.n], out=self.sums[1:])

    def of(self, size: int) -> np.ndarray:
        """Hash of words i .. i+size-1 for every i; runs may cross documents, so callers mask with :func:`fits`."""
        if self.n < size:
            return np.zeros(0, np.uint64)
        h = (self.sums[size:] - self.sums[: self.n - size + 1]) * self.down[: self.n - size + 1]
        return mix(h + np.uint64(size * int(_ODD) & (2**64 - 1)))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(h + (end - start).astype(np.uint64) * _ODD)


def owner(first: np.ndarray) -> np.ndarray:
    """Document number of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def fits(first: np.ndarray, size: int) -> np.ndarray:
    """True at word i if words i .. i+size-1 lie in one document; as long as ``Grams.of(size)``."""
    n = int(first[-1]) - size + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(first[1:], np.diff(first))[:n]
    return np.arange(n) + size <= end


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i+width] for every i, by doubling."""
    if len(x) < width:
        return x[:0]
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """True at every word inside a run of ``size`` words that begins at one of ``starts``; ``n`` words in all."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + size, n), -1)
    return np.cumsum(delta[:-1]) > 0


def text_blocks(batch: pa.RecordBatch, column: str, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cuts a batch into slices of about ``block_bytes`` of text (one document at least): slice, bytes, offsets.

    A null text is an empty one.
    """
    col = batch.column(batch.schema.get_field_index(column))
    if col.null_count:
        col = col.fill_null("")
    large = pa.types.is_large_string(col.type)
    offs = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
    raw = col.buffers()[2] if len(col) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(col):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + block_bytes, side="right")) - 1)
        end = min(end, len(col))
        yield batch.slice(at, end - at), data[offs[at] : offs[end]], (offs[at : end + 1] - offs[at]).astype(np.int64)
        at = end
