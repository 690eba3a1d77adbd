"""Word and shingle hashes of many texts at once, from their UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes hashed at once: bounds memory however long a text is.
SLICE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, base, np.uint64))])


_UP, _DOWN = _powers(_BASE, SLICE), _powers(_INVERSE, SLICE)
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over all 64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes with A to Z in lower case, and the n + 1 borders of the texts; a null is empty."""
    data = texts.fill_null("").cast(pa.large_binary())
    borders = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[borders[0]:borders[-1]]
    return LOWER[raw], borders - borders[0]


def word_borders(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes that are no white space and lie within one text."""
    solid = ~SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    first[inner] = solid[inner]
    starts = np.flatnonzero(first)
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    last[inner - 1] = solid[inner - 1]
    return starts, np.flatnonzero(last) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes. Words are taken in slices; a word longer than a slice is folded piece by piece."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(int(np.searchsorted(ends, a + SLICE, "right")), i + 1)
        if ends[i] - a > SLICE:
            h = np.zeros(1, np.uint64)
            for x in range(a, ends[i], SLICE):
                part = data[x:min(x + SLICE, ends[i])]
                h = mix(h + (_BYTE[part] * _UP[:len(part)]).sum())
            out[i] = h[0]
        else:
            part = data[a:ends[j - 1]]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[part] * _UP[:len(part)])])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = mix((sums[e] - sums[s]) * _DOWN[s] + (e - s).astype(np.uint64))
        i = j
    return out


def shingle_hashes(words: np.ndarray, size: int = 5) -> np.ndarray:
    """A hash of every run of ``size`` words; of all words together where there are fewer, none where there is no word."""
    if not len(words):
        return words
    n = min(size, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i:len(words) - n + 1 + i])
    return h


def shingle_sets(texts: pa.Array, size: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, borders = text_bytes(texts)
    starts, ends = word_borders(data, borders)
    hashes = word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, borders)
    return [np.unique(shingle_hashes(hashes[a:b], size)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
