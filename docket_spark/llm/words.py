"""Hashes of the words of many texts at once, by numpy."""

from __future__ import annotations

import functools

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=4)
def powers(n: int, odd: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of ``odd`` and of its inverse, modulo 2^64."""
    up = np.full(n, odd, dtype=np.uint64)
    down = np.full(n, pow(odd, -1, 1 << 64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ x >> np.uint64(31)) * _MIX


def runs(
    texts: list[bytes], kinds: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes of one kind (``kinds`` by byte; 0 separates).

    Returns the joined bytes, and of each run its first byte there, its end, its hash of 64 bits, and
    of each text its number of runs. The joined bytes begin with one line break and have one after
    each text, which must be of kind 0.
    """
    joined = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    kind = kinds[joined]
    turn = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    start = turn[kind[turn] != 0]
    stop = turn[kind[turn - 1] != 0]
    up, down = powers(1 << int(len(joined)).bit_length())
    total = np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[: len(joined)])
    hashed = mixed((total[stop - 1] - total[start - 1]) * down[start])
    ends = np.cumsum([len(x) + 1 for x in texts])
    return joined, start, stop, hashed, np.diff(np.searchsorted(start, np.append(0, ends), "right"))
