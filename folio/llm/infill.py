"""Fill-in-middle: texts cut at two token boundaries and written as prefix, suffix, middle, by big integers as bit sets.

A token is a run of the letters A-Z and a-z, or any other single code point. Bit i of a mask stands for byte i of the
UTF-8 text: bytes.translate turns the text into the digits of two masks, letters and inner bytes (0x80-0xBF, which start
no code point). One shifted and-not marks the starts of tokens, bit_count gives their number n, and the byte where the
k-th token starts is found by halving the mask and counting its lower half, which costs as much as one look at the mask.
So every step but the last few takes a machine word of bytes at a time, and memory is some bytes per byte of one text.

The cuts come from a hash of seed and doc_id, so a rerun or a lost task gives the same rows, and no row leaves its
partition: there is no shuffle. Output of a form:

    plain  the text                          psm  <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Texts that are empty or hold a mark are plain, whatever the hash says, so that restore() is exact.

Defined cases: a null text is empty; a null doc_id hashes like the empty string; repeated rows give repeated rows; further
columns are ignored, whatever their names; bytes that aren't UTF-8 stay as they are; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import only, small_batches

MARKS = (b"<P>", b"<S>", b"<M>")
_LETTER = bytes(0x31 if chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz" else 0x30 for c in range(256))
_INNER = bytes(0x31 if 0x80 <= c < 0xC0 else 0x30 for c in range(256))


def masks(raw: bytes) -> tuple[int, int]:
    """Bit sets over the bytes: where a token starts, and where a code point starts."""
    if not raw:
        return 0, 0
    turned = raw[::-1]  # the first byte is the lowest bit
    letters = int(turned.translate(_LETTER), 2)
    points = (1 << len(raw)) - 1
    if not raw.isascii():
        points ^= int(turned.translate(_INNER), 2)
    return points & ~(letters & letters << 1), points


def select(mask: int, width: int, k: int) -> int:
    """Place of the k-th set bit, from 0; width if there are no more than k."""
    if k >= mask.bit_count():
        return width
    base = 0
    while width > 1:
        half = width >> 1
        low = mask & (1 << half) - 1
        n = low.bit_count()
        if k < n:
            mask, width = low, half
        else:
            mask, width, k, base = mask >> half, width - half, k - n, base + half
    return base


def rewrite(raw: bytes, key: str, plain: int = 10, spm: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text; key: what is hashed.

    plain: per cent of the texts that stay as they are; spm: per cent of the others that start with the suffix.
    """
    digest = hashlib.sha256(key.encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    tokens, points = masks(raw)
    n = tokens.bit_count()
    if not raw or h3 % 100 >= 100 - plain or any(m in raw for m in MARKS):
        return n, "plain", None, None, raw
    a, b = (select(tokens, len(raw), k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = raw[:a], raw[a:b], raw[b:]
    chars = [(points & (1 << i) - 1).bit_count() for i in (a, b)]
    p, s, m = MARKS
    if h4 % 100 < spm:
        return n, "spm", chars[0], chars[1] - chars[0], b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", chars[0], chars[1] - chars[0], b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches, "text"):
            rows = [rewrite(raw, f"{seed}:{key}", plain, spm) for key, raw in zip(b.column("_key").to_pylist(), b.column("text").to_pylist(), strict=True)]
            n, form, prefix, middle, out = zip(*rows, strict=True)
            long = pa.int64()
            out = pa.Array.from_buffers(pa.string(), len(out), pa.array(out, pa.binary()).buffers())  # as the bytes are
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, long), pa.array(form), pa.array(prefix, long), pa.array(middle, long), out], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_key"))
    return docs.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column | str = "output", form: Column | str = "form") -> Column:
    """The text that an output was made of. No mark can stand in its parts, nor over a seam, as only marks' starts are `<`."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>")  # before the first mark: nothing
    first, second, middle = (F.get(parts, i) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """rows of transform() with hashes in place of the output: its own, and that of the text restored from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored()).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (
  SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
         least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END AS out FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(out) AS output_sha256, sha256(t) AS restored_sha256
FROM o
"""
