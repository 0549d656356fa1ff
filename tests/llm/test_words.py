import re

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from folio.llm._words import grams, split_words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(st.sampled_from("aAbé 😀\n\t\x0b\x1c\xa0"), max_size=30)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6), st.integers(1, 64))
def test_words_as_regex(texts, block):
    w = split_words(texts, block)
    seen = {}
    for i, t in enumerate(texts):
        a, b = w.first[i], w.first[i + 1]
        found = [(m.start(), m.end()) for m in WORD.finditer(t or "")]
        assert list(zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)) == found
        for h, (s, e) in zip(w.hash[a:b].tolist(), found, strict=True):
            word = re.sub("[A-Z]+", lambda m: m[0].lower(), t[s:e])
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_grams():
    h = np.arange(10, dtype=np.uint64)
    assert len(grams(h, 5)) == 6 and len(grams(h[:4], 5)) == 0
    assert grams(np.tile(h[:3], 2), 3)[0] == grams(np.tile(h[:3], 2), 3)[3]
