"""Words of many texts at once: every step is one numpy pass over the bytes of an Arrow column.

A word is a run of bytes other than 0x20 and 0x09-0x0D; these never lie inside a UTF-8 sequence, so bytes give the
same words as characters. Hashes are 64-bit polynomials over the bytes, mixed; they are used to find candidates and
to compare words, never as identifiers that a result shows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)


class Words(NamedTuple):
    hash: np.ndarray  # uint64 per word
    start: np.ndarray  # character where the word starts, in its text
    end: np.ndarray  # character after it
    first: np.ndarray  # texts + 1: the first word of each text


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POW: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POW.get(base, ())) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        p = np.full(size, base, np.uint64)
        p[0] = 1
        _POW[base] = np.multiply.accumulate(p)
    return _POW[base][:n]


def split_words(texts: list[str | None], block: int = 1 << 20) -> Words:
    """Words of some texts; null counts as empty. A-Z are lower-cased in the hashes only.

    The bytes are scanned in blocks that end at a space, so one very long text needs no more than its own size.
    """
    raw = [x.encode() if x else b"" for x in texts]
    begin = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in raw], out=begin[1:])
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)  # a space after each text, so that words of two don't join
    hashes, starts, ends, cs, ce, at, seen = [], [], [], [], [], 0, 0
    while at < len(data):
        stop = min(len(data), at + block)
        while stop < len(data) and not _SPACE[data[stop - 1]]:
            gap = np.flatnonzero(_SPACE[data[stop : stop + block]])
            stop = stop + int(gap[0]) + 1 if len(gap) else min(len(data), stop + block)
        d = data[at:stop]
        edge = np.flatnonzero(np.diff(_SPACE[d].view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        s, e = edge[0::2], edge[1::2]
        pre = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((_LOWER[d].astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(d)), out=pre[1:])
        hashes.append(mix((pre[e] - pre[s]) * _powers(_INV, len(d))[s] + (e - s).astype(np.uint64)))
        chars = np.cumsum((d & 0xC0) != 0x80) + seen  # characters up to and with each byte
        cs.append(chars[s] - 1)
        ce.append(np.where(e > 0, chars[np.maximum(e, 1) - 1], seen))
        starts.append(s + at)
        seen, at = int(chars[-1]), stop
    if not starts:
        z = np.zeros(0, np.int64)
        return Words(z.astype(np.uint64), z, z, np.zeros(len(raw) + 1, np.int64))
    s = np.concatenate(starts)
    first = np.searchsorted(s, begin)
    lens = np.array([len(x) if x else 0 for x in texts], np.int64) + 1
    base = np.repeat(np.cumsum(lens) - lens, np.diff(first))
    return Words(np.concatenate(hashes), np.concatenate(cs) - base, np.concatenate(ce) - base, first)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; the last k - 1 positions have none."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    n = len(h) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out)
