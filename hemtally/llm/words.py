"""Words and word shingles of many texts at once, as 64-bit values in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that separate words (space, and tab to carriage return).
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the next call unless it is long."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes_between(data: bytes | np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    data = np.frombuffer(data, np.uint8)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_P, len(data)), out=sums[1:])
    h = (sums[ends] - sums[starts]) * _power(_P_INVERSE, len(data) + 1)[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(texts: list[str | None], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, with `lower` A-Z lower-cased, and where each text's words begin (one more than texts)."""
    parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        parts = [p.lower() for p in parts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    ends_of = np.cumsum([len(p) + 1 for p in parts])
    space = _IS_SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    h = hashes_between(data, starts, ends)
    return h, np.concatenate([[0], np.searchsorted(starts, ends_of)])


def rolling_hashes(words: np.ndarray, window: int, base: int) -> np.ndarray:
    """Rabin-Karp hashes of all runs of `window` words, modulo 2 ** 64, from differences of one running sum; `base` is odd."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(base, len(words)), out=sums[1:])
    return mix((sums[window:] - sums[:-window]) * _power(pow(base, -1, 1 << 64), n))


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct k-word shingles; of fewer words, the whole sequence is one."""
    h, at = word_hashes(texts)
    n = len(h)
    m = max(0, n - k + 1)
    rolled = np.zeros(m, np.uint64)
    for j in range(k):
        rolled = rolled * np.uint64(0x2545F4914F6CDD1D) + h[j : j + m]
    rolled = mix(rolled)
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in h[a:b]:
                    whole = whole * np.uint64(0xD1342543DE82EF95) + x
            out.append(mix(np.array([whole], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
