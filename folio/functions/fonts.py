"""Advance widths of the two fonts of exported PDFs, in thousandths of the size."""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np

# Widths of Helvetica's characters U+0020 to U+007E, as in the metrics of the standard fonts.
HELVETICA = [
    278, 278, 355, 556, 556, 889, 667, 191, 333, 333, 389, 584, 278, 333, 278, 278,
    556, 556, 556, 556, 556, 556, 556, 556, 556, 556, 278, 278, 584, 584, 584, 556,
    1015, 667, 667, 722, 722, 667, 611, 778, 722, 278, 500, 667, 556, 833, 722, 778,
    667, 778, 722, 667, 611, 722, 667, 944, 667, 667, 611, 278, 278, 278, 469, 556,
    333, 556, 556, 500, 556, 556, 278, 556, 556, 222, 222, 500, 222, 833, 556, 556,
    556, 556, 333, 500, 278, 556, 500, 722, 500, 500, 500, 334, 260, 334, 584,
]
OTHER = 556  # of its further characters of Latin-1
NARROW, WIDE = 500, 1000  # of the wide font: below U+0100, and above
ASCENT, DESCENT, LEADING = 718, 207, 231
LINE = (ASCENT + DESCENT + LEADING) / 1000

_LATIN = np.full(256, OTHER, np.int64)
_LATIN[0x20:0x7F] = HELVETICA
_WIDTHS = _LATIN.tolist()
_IS_LATIN = re.compile("[\x20-\x7e\xa0-\xff]*")


def is_latin(text: str) -> bool:
    """Whether the first font has all characters of a text."""
    return _IS_LATIN.fullmatch(text) is not None


def advances(text: str, latin: bool) -> np.ndarray:
    if latin:
        return _LATIN[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
    return np.where(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) < 0x100, NARROW, WIDE).astype(np.int64)


def sums(text: str, latin: bool) -> list[int]:
    """Width of each start of a text, from the empty one to the whole."""
    if latin:
        return list(accumulate(map(_WIDTHS.__getitem__, text.encode("latin-1", "replace")), initial=0))
    return list(accumulate([NARROW if c < "\u0100" else WIDE for c in text], initial=0))
