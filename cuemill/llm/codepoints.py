"""Texts of an Arrow batch as one flat numpy array of code points, and hashes over it."""

from __future__ import annotations

import numpy as np

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
#: Odd multipliers of the doubling steps of a window hash, from the golden-ratio sequence.
STEP = [np.uint64(((0x9E3779B97F4A7C15 * (2 * i + 3)) ^ (0xC2B2AE3D27D4EB4F >> i)) % 2**64 | 1) for i in range(12)]


def flatten(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offset of each text (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x.astype(np.uint64) + _M[0]) * _M[1]
    x ^= x >> np.uint64(29)
    x *= _M[2]
    x ^= x >> np.uint64(32)
    return x


def window_hashes(symbols: np.ndarray, widths: list[int]) -> dict[int, np.ndarray]:
    """For each width, a 64-bit hash of ``symbols[i : i + width]`` for each i where the window fits.

    Hashes of power-of-two windows come by doubling; another width is put together from its binary parts.
    """
    powers, top = {1: mix(symbols)}, max(widths)
    w, j = 1, 0
    while w * 2 <= top:
        h = powers[w]
        powers[w * 2] = h[: len(h) - w] * STEP[j] + h[w:] if len(h) > w else h[:0]
        w, j = w * 2, j + 1
    out = {}
    for width in widths:
        n, at, h = max(0, len(symbols) - width + 1), 0, None
        for bit in reversed(range(width.bit_length())):
            if width >> bit & 1:
                part = powers[1 << bit][at : at + n]
                h = part.copy() if h is None else h * STEP[8 + bit % 4] + part
                at += 1 << bit
        out[width] = h if h is not None else np.zeros(0, np.uint64)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all i in a row."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) - np.repeat(ends - lengths - starts, lengths)
