"""Order of placebo draws inside one cohort: the first 32 bits of md5, a column of ids at a time, for Arrow tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACE = (lambda i: i, lambda i: (5 * i + 1) % 16, lambda i: (3 * i + 5) % 16, lambda i: 7 * i % 16)
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_CHUNK = 8192  # rows whose state stays in a core's cache
_FEW = 1000  # ids of one length below which one call per id is as fast


def _md5_rows(words: list, n: int) -> np.ndarray:
    """First 32 bits of the digests of ``n`` one-block messages, given as sixteen words (a number, or one per row)."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):  # the first word of the digest is done after step 61
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        word, turn = words[_PLACE[kind](i)], _TURNS[kind][i % 4]
        if isinstance(word, int):
            f += np.uint32((_SINES[i] + word) & 0xFFFFFFFF)
        else:
            f += np.uint32(_SINES[i])
            f += word
        np.left_shift(f, np.uint32(turn), out=t), np.right_shift(f, np.uint32(32 - turn), out=f)
        f |= t
        f += b
        a, b, c, d, f = d, f, b, c, a
    return (b + np.uint32(_START[0])).byteswap()


class Ids:
    """Ids as text, by length, ready to be hashed behind any prefix."""

    def __init__(self, texts: list[bytes | None]):
        self.n = len(texts)
        by_size: dict[int, list[int]] = {}
        for at, text in enumerate(texts):
            if text is not None:
                by_size.setdefault(len(text), []).append(at)
        self.parts = [(size, np.array(at), [texts[i] for i in at]) for size, at in by_size.items()]
        self.letters = {size: np.frombuffer(b"".join(some), np.uint8).reshape(-1, size).T for size, _, some in self.parts if len(some) >= _FEW}
        self.packed: dict[tuple[int, int], list] = {}

    def _words(self, size: int, start: int) -> list:
        """The message's words with the id at byte ``start`` and its end mark and length, without the prefix."""
        if (size, start) not in self.packed:
            rows, words = self.letters[size], [0] * 16
            for j in range(size):
                w, shift = divmod(start + j, 4)
                words[w] = words[w] | (rows[j].astype(np.uint32) << np.uint32(8 * shift))
            w, shift = divmod(start + size, 4)
            words[w] = words[w] | (0x80 << 8 * shift) if isinstance(words[w], int) else words[w] | np.uint32(0x80 << 8 * shift)
            words[14] = 8 * (start + size)
            self.packed[size, start] = words
        return self.packed[size, start]

    def hashes(self, prefix: bytes) -> np.ndarray:
        """One more than the first 32 bits of md5(prefix + id); 0 for a null id."""
        out, start = np.zeros(self.n, np.uint64), len(prefix)
        for size, at, texts in self.parts:
            if size not in self.letters or start + size > 55:
                h = np.frombuffer(b"".join([hashlib.md5(prefix + x).digest()[:4] for x in texts]), ">u4")
            else:
                words = list(self._words(size, start))
                for w in range((start + 3) // 4):
                    front = int.from_bytes(prefix[4 * w : 4 * w + 4], "little")
                    words[w] = words[w] | front if isinstance(words[w], int) else words[w] | np.uint32(front)
                cut = lambda lo: [x if isinstance(x, int) else x[lo : lo + _CHUNK] for x in words]
                h = np.concatenate([_md5_rows(cut(lo), min(_CHUNK, len(at) - lo)) for lo in range(0, len(at), _CHUNK)])
            out[at] = h
        out[np.concatenate([at for _, at, _ in self.parts] or [np.empty(0, int)])] += np.uint64(1)
        return out


def cross_sums(rows: pa.Table, draws: range, seed: int) -> list[float | None]:
    """Per draw the sum of ``v``, in the draw's order, times ``b``, in order of the id: rows hold i, b, v, text and tail."""
    if rows["b"].null_count or rows["v"].null_count:
        return [None] * len(draws)
    order = lambda *names: pc.sort_indices(rows, sort_keys=[(x, "ascending") for x in names], null_placement="at_start")
    base = rows["b"].take(order("i", "b", "v")).to_numpy()
    drawn = rows.take(order("i", "v"))  # equal hashes go by id, then value
    value, tail = drawn["v"].to_numpy(), rows["tail"][0].as_py()
    ids = Ids(drawn["text"].cast(pa.binary()).to_pylist())
    bits = np.uint64(31)
    place, low = np.arange(len(value), dtype=np.uint64), np.uint64(2**31 - 1)
    out = []
    for draw in draws:
        key = np.sort((ids.hashes(f"{seed}-{draw}{tail}".encode()) << bits) | place)
        out.append(float((value[(key & low).astype(np.int64)] * base).sum()))
    return out
