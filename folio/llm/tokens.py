"""Token ids of whole texts by the public tokenizer files, word by word through a bounded cache."""

from __future__ import annotations

import functools
import importlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_LOWER = {c: c + 32 for c in [*range(0x41, 0x5B), *range(0xC0, 0xDF)] if c != 0xD7}
# Byte-level BPE shows printable bytes as themselves and the others, in order, from U+0100 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; a name with a slash is a path already."""
    return name if "/" in name else importlib.import_module("public_tokenizers").path(name)


@functools.lru_cache(maxsize=4)
def encoder(name: str) -> CachedEncoder:
    """One per Python worker, so that tasks after the first find known words."""
    return CachedEncoder(name)


class CachedEncoder:
    """tokenizers' ids of texts as little-endian unsigned 32-bit bytes.

    For tokenizers whose pre-tokens never hold white space, as word_bpe_49k.json: the ids of a text are then those of
    its words between ASCII white space, one after another. Arrow splits the texts of a call, finds the distinct words
    and puts the ids of each place together; only distinct words are looked up one by one. Words of up to 64 bytes are
    kept in two generations of at most `limit` (plus one call's). Where the tokenizer lower-cases and parts letters from
    marks (LETTERS_AND_MARKS), a new word that ends in a letter and marks has the ids of its lower-cased rest and those
    of the marks, and one of lower-case Latin letters alone, which no step before the model would change, goes to the
    model itself; others are encoded together, with a lone NUL between each two, which has an id of its own.
    """

    # Fixed value: the pre-tokenizer's pattern for which that holds.
    LETTERS_AND_MARKS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    MARKS = ".,;:!?#*$%&|"

    def __init__(self, name: str, limit: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(vocabulary(name)), limit
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        apart = self._ids("a \0 a")
        self.apart = int(apart[1]) if len(apart) == 3 else None
        told = json.loads(self.tokenizer.to_str())
        lower = any(n.get("type") == "Lowercase" for n in (told.get("normalizer") or {}).get("normalizers", []))
        splits = [p.get("pattern", {}).get("Regex") for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        levels = [p.get("type") for p in (told.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.parts = lower and self.LETTERS_AND_MARKS in splits and levels == ["Split", "ByteLevel"]
        self.model = self.tokenizer.model

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _many(self, words: list[str]) -> list[bytes]:
        if not self.parts:
            return self._together(words)
        plain = [_LETTERS.fullmatch(w) is not None for w in words]
        rest = iter(self._together([w for w, p in zip(words, plain, strict=True) if not p]))
        tokenize = self.model.tokenize
        return [array("I", [k.id for k in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]).tobytes() if p else next(rest) for w, p in zip(words, plain, strict=True)]

    def _together(self, words: list[str]) -> list[bytes]:
        if not words:
            return []
        if self.apart is not None and not any("\0" in w for w in words):
            ids = self._ids(" \0 ".join(words))
            cuts = np.flatnonzero(ids == self.apart)
            if len(cuts) == len(words) - 1:
                raw, ends = ids.tobytes(), [*(4 * cuts).tolist(), 4 * len(ids)]
                starts = [0, *(4 * cuts + 4).tolist()]
                return [raw[a:b] for a, b in zip(starts, ends, strict=True)]
        return [self._ids(w).tobytes() for w in words]

    def _parted(self, w: str) -> tuple[str, str]:
        """A word as lower-cased rest and closing marks, if they have ids apart."""
        if not self.parts or "<|" in w:
            return w, ""
        rest = w.rstrip(self.MARKS)
        if _LETTERS.match(last := rest[-1:].translate(_LOWER)) and last:
            return rest.lower() if rest.isascii() else rest.translate(_LOWER), w[len(rest) :]
        return w, ""

    def _found(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words."""
        known, older = self.known, self.older
        out = [known.get(w) for w in words]
        missing = [i for i, x in enumerate(out) if x is None]
        made, new = [], {}
        for i in missing:
            w = words[i]
            if (x := older.get(w)) is not None:
                out[i] = known[w] = x
            elif len(w) > 64 or len(w) > 16 and len(w.encode()) > 64:
                out[i] = self._ids(w).tobytes()
            else:
                rest, marks = self._parted(w)
                made.append((i, rest, marks))
                for x in (rest, marks):
                    if x not in known:
                        if x in older:
                            known[x] = older[x]
                        else:
                            new[x] = None
        some = list(new)
        for at in range(0, len(some), 2000):
            part = some[at : at + 2000]
            known.update(zip(part, self._many(part), strict=True))
        for i, rest, marks in made:
            out[i] = known[words[i]] = known[rest] + known[marks] if marks else known[rest]
        if len(known) > self.limit:
            self.older, self.known = known, {"": b""}
        return out

    def __call__(self, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
        """The ids of all texts one after another, and the byte where each text begins (and the end)."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        found = pa.array(self._found(words.dictionary.to_pylist()), pa.large_binary())
        ids = found.take(words.indices)
        _, ends, raw = ids.buffers()
        ends = np.frombuffer(ends, np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
        at = split.offsets.to_numpy()
        return raw or pa.py_buffer(b""), ends[at - at[0]]
