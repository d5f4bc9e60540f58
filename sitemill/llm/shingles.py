"""Sets of word shingles as sorted 64-bit hashes (numpy helpers used inside tasks)."""
from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _STEP, np.uint64))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs without ASCII white space, A-Z lower-cased) and the number of words of each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    byte = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    space = _SPACE[byte]
    starts = np.flatnonzero(~space & np.r_[True, space[:-1]])
    if not len(starts):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    lens = ends - starts
    first = np.r_[0, np.cumsum(lens)[:-1]]
    at = np.arange(lens.sum()) - np.repeat(first, lens)
    values = (byte[~space].astype(np.uint64) + np.uint64(1)) * _powers(int(lens.max()))[at]
    words = mix(np.add.reduceat(values, first) + lens.astype(np.uint64) * _STEP)
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    return words, np.diff(np.searchsorted(starts, np.r_[0, text_ends]))


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Each text's sorted distinct shingles of ``k`` words; a shorter text has its whole sequence as one."""
    words, counts = word_hashes(texts)
    n = max(len(words) - k + 1, 0)
    long = np.full(n, np.uint64(k))
    for i in range(k):
        long = mix(long + words[i:i + n] * np.uint64(2 * i + 3))
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            out.append(np.unique(long[at:at + c - k + 1]))
        elif c:
            h = np.array([c], np.uint64)
            for i in range(c):
                h = mix(h + words[at + i:at + i + 1] * np.uint64(2 * i + 3))
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def set_id(s: np.ndarray) -> int:
    """One signed 64-bit hash of a set."""
    if not len(s):
        return 0
    h = mix(np.add.reduce(mix(s + _STEP), keepdims=True) + np.array([len(s)], np.uint64) * _STEP)
    return int(h.view(np.int64)[0])
