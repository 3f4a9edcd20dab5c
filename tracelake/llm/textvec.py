"""Hashes of words, shingles and characters of one text, made with numpy on its UTF-8 bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS = {"n": 0, "up": None, "down": None}

#: True for the bytes that stand between words: space and \x09 to \x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWERS["n"] < n:
        size = max(1 << 16, 2 * n)
        with np.errstate(over="ignore"):
            _POWERS["up"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE)]), dtype=np.uint64)
            _POWERS["down"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, BASE_INVERSE)]), dtype=np.uint64)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words in bytes."""
    word = np.concatenate([[False], ~IS_SPACE[raw], [False]])
    turns = np.flatnonzero(word[1:] != word[:-1])
    return turns[::2], turns[1::2]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    """What span_hashes needs of a text; make it once for several calls."""
    up, _ = _powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=out[1:])
    return out


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, prefix: np.ndarray | None = None) -> np.ndarray:
    """One 64-bit hash per span of bytes; equal bytes give equal hashes wherever they stand."""
    prefix = prefix_sums(raw) if prefix is None else prefix
    _, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0xC2B2AE3D27D4EB4F) + (right ^ (right >> np.uint64(29))) * np.uint64(0x165667B19E3779F9) + np.uint64(1))


def char_grams(raw: np.ndarray, n: int, prefix: np.ndarray) -> np.ndarray:
    """Hashes of all n-byte windows, the same as span_hashes gives but for the length."""
    if len(raw) < n:
        return np.empty(0, np.uint64)
    _, down = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        return mix((prefix[n:] - prefix[:-n]) * down[: len(raw) - n + 1] + np.uint64(n))
