"""Words of UTF-8 texts as 64-bit hashes, computed on whole arrays of bytes."""

from __future__ import annotations

import numpy as np

from .common import spans

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20240917).integers(1, 2**63, 256, dtype=np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S33)) * _M2
    return h ^ (h >> _S33)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin, and their hashes. A-Z count as lower case."""
    space = _SPACE[raw]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate([[0], edge])
    if len(raw) and not space[-1]:
        edge = np.append(edge, len(raw))
    begin, end = edge[::2], edge[1::2]
    power, back = _grown(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[raw] * power[: len(raw)], out=sums[1:])
    return begin, mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64))


def word_hashes(raw: np.ndarray, offsets: np.ndarray, piece: int = 1 << 17):
    """For runs of rows: (first row, word offsets of its rows, hashes). Rows must be cut at ``offsets``."""
    for first, end in spans(offsets, piece):
        lo, hi = int(offsets[first]), int(offsets[end])
        if hi - lo <= piece:
            part = raw[lo:hi]
            inner = offsets[first + 1 : end] - lo
            if len(inner):  # a space between rows keeps their words apart
                part = np.insert(part, inner, 32)
                starts = np.concatenate([[0], inner + np.arange(1, len(inner) + 1)])
            else:
                starts = np.zeros(1, np.int64)
            begin, h = _piece(part)
            yield first, np.append(np.searchsorted(begin, starts), len(h)), h
        else:  # a long row: cut at white space
            out, at = [], lo
            while at < hi:
                stop = min(hi, at + piece)
                if stop < hi:
                    gap = np.flatnonzero(_SPACE[raw[at:stop]])
                    if len(gap):
                        stop = at + int(gap[-1]) + 1
                    else:
                        while stop < hi and not _SPACE[raw[stop]]:
                            stop += 1
                out.append(_piece(raw[at:stop])[1])
                at = stop
            h = np.concatenate(out)
            yield first, np.array([0, len(h)]), h


def shingles(offsets: np.ndarray, h: np.ndarray, words: int):
    """For each row of word hashes: its distinct shingles, sorted. Fewer words than ``words`` make one shingle."""
    n = len(h) - words + 1
    weights = _VALUES[:words] | np.uint64(1)
    every = np.zeros(max(n, 0), np.uint64)
    for k in range(words if n > 0 else 0):
        every += h[k : k + n] * weights[k]
    every = mixed(every)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= words:
            s = np.sort(every[a : b - words + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            yield s[new]
        elif b > a:
            yield mixed((h[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield every[:0]
