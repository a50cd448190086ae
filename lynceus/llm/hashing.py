"""Word hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_random = np.random.Generator(np.random.PCG64(20240229))
#: A number for each byte, and for lower-casing A-Z first.
BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
LOWER_BYTE = BYTE.copy()
LOWER_BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
C1, C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Well mixed 64-bit values, one to one."""
    x = (x ^ (x >> np.uint64(30))) * C1
    x = (x ^ (x >> np.uint64(27))) * C2
    return x ^ (x >> np.uint64(31))


_powers: dict[np.uint64, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base to the 0, 1, ... modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def pieces(texts: Sequence[bytes], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``most`` bytes together; a longer text is a range of its own."""
    start = size = 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield start, i
            start = i
            size = 0
        size += len(x)
    if start < len(texts):
        yield start, len(texts)


def word_hashes(texts: Sequence[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and where each text's words begin (one more entry: the end).

    Words are runs of bytes other than ASCII white space; A-Z count as a-z if ``lower``.
    """
    joined = b"\n".join(texts) + b"\n"
    a = np.frombuffer(joined, dtype=np.uint8)
    gap = SPACE[a]
    starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
    ends = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((LOWER_BYTE if lower else BYTE)[a] * _power(BASE, len(a)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _power(INVERSE, len(a))[starts] + (ends - starts).astype(np.uint64))
    sizes = np.fromiter((len(x) + 1 for x in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    return hashes, np.searchsorted(starts, begins)


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; of all words together, if there are fewer but any."""
    if not len(words):
        return words
    if len(words) < n:
        n = len(words)
    h = words[:len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * BASE + words[k:len(words) - n + 1 + k]
    return mix(h + np.uint64(n))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
