"""Vectorised words and word hashes of Arrow text columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}

#: ASCII letters and digits and all bytes of longer code points belong to words.
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[32, *range(9, 14)]] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()
        forth = np.full(size, _STEP, np.uint64)
        back = np.full(size, _BACK, np.uint64)
        forth[0] = back[0] = 1
        _tables[size] = np.multiply.accumulate(forth), np.multiply.accumulate(back)
    return _tables[size]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a text column in row order.

    ``data``: the (folded) bytes; ``start`` and ``end``: byte bounds of each word
    in it; ``row``: its text's index; ``first``: index of each text's first word,
    with the number of words at the end; ``hash``: 64 bits of each word.
    Null and empty texts have no words.
    """

    def __init__(self, texts: pa.Array, fold: bool = True, punctuation: bool = False, hashes: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if fold:
            texts = pc.utf8_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        low, high = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[low:high]
        bounds = offsets - low
        inside = (_NOT_SPACE if punctuation else _IN_WORD)[self.data]
        before = np.zeros(len(inside) + 1, bool)
        before[1:] = inside
        before[bounds] = False
        self.start = np.flatnonzero(inside & ~before[:-1])
        after = np.zeros(len(inside) + 1, bool)
        after[:-1] = inside
        after[bounds] = False
        self.end = np.flatnonzero(inside & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, bounds)
        self.first[-1] = len(self.start)
        self.row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(self.first))
        self.bounds = bounds
        if hashes:
            forth, back = _powers(len(self.data) + 1)
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * forth[: len(self.data)], out=sums[1:])
            self.hash = mix((sums[self.end] - sums[self.start]) * back[self.start])

    @classmethod
    def of(cls, texts: list[str], limit: int = 1 << 19) -> Words:
        """``Words`` of many texts, worked out for about ``limit`` characters at a time."""
        parts, held, size = [], [], 0
        for t in [*texts, None]:
            if held and (t is None or size + len(t) > limit):
                parts.append(cls(pa.array(held, pa.string())))
                held, size = [], 0
            if t is not None:
                held.append(t)
                size += len(t)
        out = cls(pa.array([], pa.string()))
        if parts:
            bytes_before = np.cumsum([0] + [len(p.data) for p in parts])
            words_before = np.cumsum([0] + [len(p.start) for p in parts])
            rows_before = np.cumsum([0] + [len(p.first) - 1 for p in parts])
            out.data, out.hash = np.concatenate([p.data for p in parts]), np.concatenate([p.hash for p in parts])
            out.start = np.concatenate([p.start + b for p, b in zip(parts, bytes_before, strict=False)])
            out.end = np.concatenate([p.end + b for p, b in zip(parts, bytes_before, strict=False)])
            out.row = np.concatenate([p.row + np.int32(b) for p, b in zip(parts, rows_before, strict=False)])
            out.first = np.concatenate([*[p.first[:-1] + b for p, b in zip(parts, words_before, strict=False)], words_before[-1:]])
        return out

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode()

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words within one text, and the index of each run's first word."""
        n = len(self.start)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.row[: n - k + 1] == self.row[k - 1 :])
        h = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            h = h * _STEP + self.hash[j : n - k + 1 + j]
        return mix(h[at]), at
