"""Hashes of word shingles, computed on the bytes of a whole text with numpy.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z count as a-z.  A word
is hashed by a polynomial over a random value for each byte, read off one running sum; a
shingle by a weighted sum of its words' hashes.  All arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_draw = np.random.Generator(np.random.PCG64(20240229))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = _draw.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_WEIGHT = _draw.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of a text that are hashed at once, about.
PIECE = 1 << 18


def _steps(base: np.uint64) -> np.ndarray:
    """Powers of a base for the offsets in two pieces."""
    steps = np.full(2 * PIECE + 1, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _steps(_BASE), _steps(_BACK)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the MurmurHash3 finaliser)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _hashed(raw: np.ndarray) -> np.ndarray:
    """Hashes of the words of at most two pieces' bytes."""
    solid = np.concatenate([[False], ~_BLANK[raw], [False]])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_VALUE[raw] * _UP[: len(raw)])])
    return mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64))


def _long_word(raw: np.ndarray) -> np.ndarray:
    """The hash of one word of any length, a piece at a time."""
    total = 0
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        total += pow(int(_BASE), at, 1 << 64) * int((_VALUE[part] * _UP[: len(part)]).sum(dtype=np.uint64))
    return mixed(np.array([(total + len(raw)) % (1 << 64)], np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of a text's words in order; a long text is hashed in pieces, cut where words end."""
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(raw) <= 2 * PIECE:
        return _hashed(raw) if len(raw) else np.empty(0, np.uint64)
    blanks, parts, at = np.flatnonzero(_BLANK[raw]), [], 0
    while at < len(raw):
        k = int(np.searchsorted(blanks, at + 2 * PIECE))
        if at + 2 * PIECE >= len(raw):
            end = len(raw)
        elif k and blanks[k - 1] >= at:
            end = int(blanks[k - 1]) + 1
        else:
            # A word longer than two pieces starts here.
            end = int(blanks[k]) if k < len(blanks) else len(raw)
            parts.append(_long_word(raw[at:end]))
            at = end
            continue
        parts.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; fewer words are one shingle."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    if len(words) < size:
        return mixed((words * _WEIGHT[: len(words)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(words)))
    last = len(words) - size + 1
    return np.unique(mixed(sum(words[k : k + last] * _WEIGHT[k] for k in range(size))))
