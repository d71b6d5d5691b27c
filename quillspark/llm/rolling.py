"""Hashes of all windows of many texts at once, by sums modulo 2**64."""

from __future__ import annotations

import numpy as np

# An odd multiplier for rolling sums modulo 2**64 and its inverse; any odd number serves.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64; kept for the next call."""
    if len(_POWERS.get(base, ())) < n:
        row = np.full(max(n, 1 << 21), base, np.uint64)
        row[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(row, dtype=np.uint64)
    return _POWERS[base][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed scrambling of 64-bit values, so that sums of them collide only by chance."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(32))


def normalise(text: str) -> str:
    """Lower case, each run of white space (space, tab, CR, LF) one space, trimmed."""
    text = text.lower().replace("\n", " ").replace("\r", " ").replace("\t", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text.strip(" ")


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, starts, lengths): code points of all texts one after the other, each closed by
    a value of its own, so that no window over a border equals another."""
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4").copy()
    closing = np.cumsum(lengths + 1) - 1
    codes[closing] = 0x110000 + np.arange(len(texts))
    return codes, closing - lengths, lengths


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(codes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * powers(len(codes), BASE), out=sums[1:])
    return sums


def window_hashes(sums: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of ``width`` characters that begin at ``at``."""
    with np.errstate(over="ignore"):
        return mix((sums[at + width] - sums[at]) * powers(len(sums), INVERSE)[at])
