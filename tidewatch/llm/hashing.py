"""Vectorised 64-bit hashes of the words of many texts.

A word is a run of bytes outside a separator set; ASCII letters may be folded. The hash of a
word is a polynomial over its bytes, read from one running sum, so no Python object is made
per word. Separators are ASCII, hence cutting UTF-8 at them is safe.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WINDOW = 1 << 20


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for base in (_BASE, inverse):
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


@lru_cache(maxsize=8)
def _byte_values(separators: bytes) -> tuple[np.ndarray, np.ndarray]:
    """For each byte a random value with A-Z folded, 0 for separators; and a separator flag."""
    values = np.random.default_rng(20240117).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    blank = np.zeros(256, dtype=bool)
    blank[list(separators)] = True
    values[blank] = 0
    return values, blank


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _window_words(raw: np.ndarray, separators: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, blank = _byte_values(separators)
    is_blank = blank[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], is_blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.empty(0, dtype=np.uint64)
    power, inverse = _powers(max(_WINDOW, 1 << int(len(raw)).bit_length()))
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(values[raw] * power[: len(raw)], dtype=np.uint64, out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return starts, ends, mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words_of(data: bytes, separators: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word; long data is read in windows that end at a separator."""
    raw = np.frombuffer(data, dtype=np.uint8)
    if len(raw) <= _WINDOW:
        return _window_words(raw, separators)
    _, blank = _byte_values(separators)
    found, at = [], 0
    while at < len(raw):
        end, step = at + _WINDOW, _WINDOW
        while end < len(raw):  # back to a separator, or on while one word fills the window
            cut = np.flatnonzero(blank[raw[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
                break
            step *= 2
            end = at + step
        starts, ends, hashes = _window_words(raw[at:end], separators)
        found.append((starts + at, ends + at, hashes))
        at = min(end, len(raw))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def texts_words(texts: list[str | None], separators: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in one array, and where each text begins (and the last ends)."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts, _, hashes = words_of(b" ".join(coded), separators)
    begins = np.cumsum([0] + [len(c) + 1 for c in coded])
    return hashes, np.searchsorted(starts, begins)


_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size`` consecutive words; a shorter text is one shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, dtype=np.uint64)
    width = min(n, size)
    h = np.full(n - width + 1, width, dtype=np.uint64)
    for k in range(width):
        h = h + words[k : n - width + 1 + k] * _MULTIPLIERS[k]
    return np.unique(mix(h))
