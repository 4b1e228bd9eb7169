"""Words of many texts hashed at once, with numpy over the bytes of an Arrow column.

A word is a run of bytes that are no separators; A-Z count as a-z. Its hash is a polynomial in random values of its bytes,
taken from sums over the whole buffer, then scrambled: 64 bits, the same for equal words wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .near_dedup import mix

PIECE = 1 << 20
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_BACK = pow(_STEP, -1, 1 << 64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings; null is empty."""
    texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


class WordHasher:
    def __init__(self, separators: bytes) -> None:
        self.apart = np.zeros(256, bool)
        self.apart[list(separators)] = True
        self.values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
        self.values[ord("A") : ord("Z") + 1] = self.values[ord("a") : ord("z") + 1]
        self.powers = self.backs = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            steps = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)], dtype=np.uint64)
            self.powers, self.backs = steps(_STEP), steps(_BACK)

    def _hash(self, data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of data and where they begin; no word goes on past a break."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self._reach(n)
        apart = self.apart[data]
        first, last = np.empty(n, bool), np.empty(n, bool)
        first[0] = last[-1] = True
        first[1:], last[:-1] = apart[:-1], apart[1:]
        breaks = breaks[(breaks > 0) & (breaks < n)]
        first[breaks] = last[breaks - 1] = True
        begin, end = np.flatnonzero(first & ~apart), np.flatnonzero(last & ~apart) + 1
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(self.values[data] * self.powers[:n], dtype=np.uint64, out=sums[1:])
        return mix((sums[end] - sums[begin]) * self.backs[begin]), begin

    def _long(self, data: np.ndarray) -> np.ndarray:
        """Hashes of one long text's words, piece by piece; a piece ends at a separator."""
        found, at = [], 0
        while at < len(data):
            end = min(len(data), at + PIECE)
            while end < len(data) and not self.apart[data[end]]:
                ahead = np.flatnonzero(self.apart[data[end : end + PIECE]])
                end = end + int(ahead[0]) if len(ahead) else min(len(data), end + PIECE)
            found.append(self._hash(data[at:end], np.zeros(0, np.int64))[0])
            at = end
        return np.concatenate(found)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts lo to hi, of about PIECE bytes or one longer text: lo, hi, the hashes of their words in order, how many each has."""
        at, data = text_bytes(texts)
        lo, n = 0, len(at) - 1
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + PIECE, "right")) - 1)
            hi = min(hi, n)
            part = data[at[lo] : at[hi]]
            if hi == lo + 1 and len(part) > PIECE:
                hashes = self._long(part)
                yield lo, hi, hashes, np.array([len(hashes)])
            else:
                starts = at[lo : hi + 1] - at[lo]
                hashes, begin = self._hash(part, starts)
                yield lo, hi, hashes, np.diff(np.searchsorted(begin, starts))
            lo = hi
