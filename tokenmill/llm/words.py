"""Words of whole texts as numpy arrays, straight from Arrow's text buffers.

A batch of texts is one byte buffer with offsets; words are found with a table of
256 byte classes, so no Python object is made per word. A word's hash covers all its
bytes (64 bit); n-gram hashes combine the hashes of consecutive words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 1 << 20


def _byte_class(excluded) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: `[^\x20\x09-\x0D]+`
SPACED = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after lower-casing A-Z
ALNUM = _byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95  # odd
_GRAM = 0xDA942042E4DD58B5  # odd


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, dtype=_U)
    p[0] = 1
    return np.cumprod(p)


@dataclass
class Words:
    """Words of a few texts: byte bounds, 64-bit hashes, and the word offsets of each text."""

    raw: np.ndarray  # all bytes, case kept
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    offset: np.ndarray  # n_texts + 1 word positions

    def __len__(self) -> int:
        return len(self.offset) - 1

    def counts(self) -> np.ndarray:
        return np.diff(self.offset)

    def text_of(self) -> np.ndarray:
        """Which text each word belongs to."""
        return np.repeat(np.arange(len(self)), self.counts())

    def joined(self, i: int, keep: np.ndarray | None = None) -> bytes:
        """Words of text ``i`` (those where ``keep``), unchanged, joined by one space."""
        a, b = self.offset[i], self.offset[i + 1]
        s, e = self.start[a:b], self.end[a:b]
        if keep is not None:
            s, e = s[keep], e[keep]
        if not len(s):
            return b""
        # every kept word with one byte after it; that byte becomes the space
        size = e - s + 1
        at = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        out = self.raw[np.minimum(at, len(self.raw) - 1)]
        out[np.cumsum(size) - 1] = 32
        return out[:-1].tobytes()


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def words(texts: pa.Array, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    raw, off = buffers(texts)
    n = len(raw)
    if not n:
        z = np.empty(0, np.int64)
        return Words(raw, z, z, np.empty(0, _U), np.zeros(len(off), np.int64))
    code = _LOWER[raw] if lower else raw
    inside = kind[code]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[off[:-1][off[:-1] < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[off[1:][off[1:] > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    offset = np.searchsorted(start, off)
    if not len(start):
        return Words(raw, start, end, np.empty(0, _U), offset)
    first = start[0]
    place = np.arange(first, n) - np.repeat(start, np.diff(np.append(start, n)))
    size = end - start
    value = np.where(kind, _BYTE, _U(0))[code[first:]]
    value *= _powers(_BASE, int(size.max()))[np.minimum(place, size.max() - 1)]
    h = mix64(np.add.reduceat(value, start - first) + size.astype(_U))
    return Words(raw, start, end, h, offset)


def gram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each word on, and whether those lie in one text."""
    h, size = w.hash, len(w.hash)
    if size < n:
        return np.empty(size, _U), np.zeros(size, bool)
    # prefix sums of hash * base^i; a window is a difference, moved to one place by the inverse power
    p = _powers(_GRAM, size + 1)
    inv = _powers(pow(_GRAM, -1, 1 << 64), size + 1)
    total = np.concatenate((np.zeros(1, _U), np.cumsum(h * p[:size])))
    out = np.zeros(size, _U)
    out[: size - n + 1] = mix64((total[n:] - total[: size - n + 1]) * inv[: size - n + 1])
    whole = np.arange(size) + n <= np.repeat(w.offset[1:], w.counts())
    return out, whole


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes of text (one row at least)."""
    if not len(texts):
        return
    size = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(size)
    i, n = 0, len(size)
    while i < n:
        base = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, base + most, "right")))
        yield i, j
        i = j
