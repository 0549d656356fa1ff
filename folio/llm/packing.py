"""Best-fit packing of token sequences under several capacities at once.

A sequence (bin) has a residual vector: tokens, documents and attention cost (the sum of squared piece lengths). Pieces
are placed longest first; each goes to the bin that can take it in every dimension and is left with the least weighted
norm of its residual vector, each part as a share of its capacity, or opens a new one. Bins are indexed by residual
tokens (a bit set finds the next level). What is left of the cost is at least what the used tokens allow, so the norm
of a level has a lower bound that rises with its tokens, and the search ends at the first level beyond the best so far.

Pieces are dealt by a number of their row, not by what they hold, into shards of about SHARD rows, each packed by
itself: a shard leaves a few part-filled bins, in some thousands, and no task holds more than a shard, repeated rows or
not.

Defined cases: a null text counts as empty and is one piece of the end id alone; repeated rows are packed each; a piece
that alone exceeds a capacity raises ValueError; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise, only, runs, small_batches
from .tokens import encoder

SHARD = 1 << 16
CAPACITY = (4096, 4096, 4096 * 4096)
WEIGHT = (1.0, 0.3, 0.3)


def best_fit(lengths: list[int], capacity=CAPACITY, weight=WEIGHT) -> tuple[list[int], list[int]]:
    """(bin, offset) of each piece; the pieces have to come longest first."""
    tokens, docs, cost = capacity
    wt, wd, wc = weight[0] / tokens**2, weight[1] / docs**2, weight[2] / cost**2
    levels: dict[int, dict[tuple[int, int], list[int]]] = {}
    mask, bins, where, offset = 0, 0, [], []
    for n in lengths:
        c = n * n
        if n > tokens or docs < 1 or c > cost:
            raise ValueError(f"a piece of {n} tokens exceeds a capacity")
        best, at = None, None
        rest = mask >> n
        while rest:
            r = n + (rest & -rest).bit_length() - 1
            spare = cost - (tokens - r) ** 2 - c  # no bin of this level is left with less of the cost
            low = wt * (r - n) ** 2 + (wc * spare * spare if spare > 0 else 0.0)
            if best is not None and low >= best:
                break
            for s in levels[r]:
                if s[0] >= 1 and s[1] >= c:
                    norm = wt * (r - n) ** 2 + wd * (s[0] - 1) ** 2 + wc * (s[1] - c) ** 2
                    if best is None or norm < best:
                        best, at = norm, (r, s)
            rest &= rest - 1
        if at is None:
            b, (r, s) = bins, (tokens, (docs, cost))
            bins += 1
        else:
            r, s = at
            level = levels[r]
            b = level[s].pop()
            if not level[s]:
                del level[s]
                if not level:
                    del levels[r]
                    mask ^= 1 << r
        where.append(b)
        offset.append(tokens - r)
        if r > n and s[0] > 1:
            left, key = r - n, (s[0] - 1, s[1] - c)
            levels.setdefault(left, {}).setdefault(key, []).append(b)
            mask |= 1 << left
    return where, offset


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, size: int = 4096, ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each text's ids and the end id, cut only where over size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        end = end_id.to_bytes(4, "little")
        for b in small_batches(batches, "text", 4_000_000):
            row, piece, start, length, crc, content = [], [], [], [], [], []
            found, bounds = encode(b.column("text"))
            found, bounds = memoryview(found), bounds.tolist()
            for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False)):
                for k, at in enumerate(range(s, e + 4, 4 * size)):  # the end id comes after e
                    stop = min(at + 4 * size, e + 4)
                    part = found[at : min(stop, e)]
                    row.append(i), piece.append(k), start.append((at - s) // 4), length.append((stop - at) // 4)
                    crc.append(zlib.crc32(end, zlib.crc32(part)) if stop > e else zlib.crc32(part))
                    if ids:
                        content.append(bytes(part) + end * (stop > e))
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(content, pa.binary())] * ids, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    docs = only(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids)


def pack(rows: DataFrame, capacity=CAPACITY, weight=WEIGHT, shard: int = SHARD) -> DataFrame:
    """rows (with a column length) and sequence_id, offset: the sequence of each and its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["_shard"]):
            for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = t.slice(s, e - s)
                where, offset = best_fit(part.column("length").to_pylist(), capacity, weight)
                base = part.column("_shard")[0].as_py() << 32
                part = part.drop_columns(["_shard"]).append_column("sequence_id", pa.array([base + b for b in where], pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
                yield from part.to_batches()

    rows = materialise(rows, "pieces")
    shards = max(1, -(-rows.count() // shard))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    n = max(1, min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = dealt.repartition(n, "_shard").sortWithinPartitions("_shard", F.desc("length"), *(c for c in rows.columns if c != "length"))
    schema = rows.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, size: int = 4096, max_docs: int | None = None, weight=WEIGHT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all documents in sequences of `size` tokens.

    max_docs: the most pieces of a sequence; by default only tokens bind, as a piece has a token at least and the cost of
    a whole sequence is never above size**2.
    """
    return pack(pieces(docs, tokenizer, end_id, size), (size, max_docs or size, size * size), weight)
