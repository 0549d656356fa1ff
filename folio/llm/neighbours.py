"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes with error bounds, exact reranking.

build() turns every vector o into a code. With a centre c, r = |o - c| and a random rotation P, the code is the signs of
P(o - c), packed into 64-bit words; s is the inner product of the unit vector P(o - c) / r and the code read as a unit vector.
A query's P(q - c) is rounded to BITS bits a dimension; and, popcount and shift of its bit planes with a code's words give
their inner product, from which r and s give an estimate of <o, q> (Gao and Long, SIGMOD 2024). Its error is at most

    SURE * (|q - c| r sqrt((1 - s**2) / (s**2 (d - 1))) + step r / (s sqrt(12)))

but for a small share of the pairs: the first part is that of the code, the second that of rounding the query. A vector is
reranked, by its exact inner product in double precision, if its estimate plus this bound reaches the k-th best exact one so
far. Codes only choose; every score and the order of the result come from the original vectors.

search() deals queries and index in blocks: each block of queries meets each slice of the index in one group of bounded
size, which gives its k best per query; a window takes the best k of all slices. Slices are drawn by hash, so no list,
label or run of equal vectors can make one larger than others. There are no coarse lists: on the given vectors, whose
clusters are nearly round, lists would have to read over half of the table for a recall of 0.9 (README).

Defined cases: null vectors, zero ones and those with null or non-finite components take no part, nor do rows without an
id; of rows that share an id the least vector, compared as arrays, is taken; vectors meet only those of their own length;
equal scores are in order of vec_id; a query with fewer than k candidates gets all; further columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise

SLICE, BLOCK, SLICES = 32768, 4096, 12  # most rows of a slice and of a block of queries, about; least number of slices
SAMPLE = 4096  # vectors of which the centre is the mean, about; any centre gives right bounds
BITS = 4
SURE = 2.4
SEED = 42


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix of the least multiple of 64 that is d or more."""
    n = -(-d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed codes (rows of 64-bit words), r and s of some vectors."""
    y = np.zeros((len(x), len(turn)))
    y[:, : x.shape[1]] = x - centre
    y = y @ turn.T
    r = np.sqrt((y * y).sum(1))
    s = np.abs(y).sum(1) / np.where(r > 0, r, 1) / np.sqrt(len(turn))
    return np.packbits(y > 0, axis=1, bitorder="little").view(np.uint64), r, np.where(r > 0, s, 1.0)


class Codes:
    """A slice of the index, and the best exact scores that each query of a block found in it."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, r: np.ndarray, s: np.ndarray, centre: np.ndarray):
        self.ids, self.x, self.words, d = ids, x, np.ascontiguousarray(code.T), code.shape[1] * 64
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        self.scale = r / (s * np.sqrt(d))
        # times (lowest level, 1, |q - c|, step, -step * sum of levels): all of estimate and bound but the planes
        self.rest = np.column_stack([self.scale * (2 * ones - d), x @ centre, SURE * r * np.sqrt(np.maximum(0, 1 - s * s) / (s * s * max(1, d - 1))), SURE * r / (s * np.sqrt(12)), self.scale])

    def best(self, own: int, q: np.ndarray, turned: np.ndarray, shift: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for one query, best first; turned: P(q - c); shift: <q, c> - <c, c>."""
        low = float(turned.min())
        step = float(turned.max() - low) / (2**BITS - 1) or 1.0
        level = np.rint((turned - low) / step).astype(np.uint8)
        total = np.zeros(len(self.ids), np.int64)
        for b in range(BITS):
            for w, plane in zip(self.words, np.packbits(level >> b & 1, bitorder="little").view(np.uint64), strict=True):
                total += np.bitwise_count(w & plane).astype(np.int64) << b
        norm = float(np.sqrt(turned @ turned))
        upper = self.rest @ np.array([low, 1.0, norm, step, -step * float(level.sum())]) + 2 * step * self.scale * total + shift
        upper[self.ids == own] = -np.inf
        n = len(upper)
        first = np.argpartition(upper, n - 4 * k)[n - 4 * k :] if n > 4 * k else np.arange(n)
        first = first[upper[first] > -np.inf]
        score = (self.x[first] * q).sum(1)
        if n > 4 * k and len(first) >= k:
            least = np.partition(score, len(score) - k)[len(score) - k]
            upper[first] = -np.inf
            more = np.flatnonzero(upper >= least)
            first, score = np.append(first, more), np.append(score, (self.x[more] * q).sum(1))
        keep = np.lexsort((self.ids[first], -score))[:k]
        return self.ids[first[keep]], score[keep]


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _centre(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean of a sample of about SAMPLE vectors of each length, or of all if they are fewer. Only means leave the tasks."""
    counts = rows.groupBy("dim").count().limit(65).collect()  # lengths of vectors, not rows
    if len(counts) > 64:
        raise ValueError("over 64 lengths of vectors")
    out = {}
    for d, n in counts:
        drawn = rows.where((F.col("dim") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // SAMPLE))) == 0))
        out[d] = np.zeros(d)
        for r in drawn.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect():
            out[d][r["i"]] = r["m"]
    return out


def build(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The index, a written table: vec_id, dim, x (the vector in doubles), centre, code, r, s. Every vector has a row."""
    v = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("x"))
    sound = F.forall("x", lambda y: F.coalesce(~F.isnan(y) & (F.abs(y) < float("inf")), F.lit(False))) & F.exists("x", lambda y: y != 0)
    v = v.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = materialise(v.groupBy("vec_id").agg(F.min("x").alias("x")).withColumn("dim", F.size("x")), "vectors")
    centres = _centre(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = {d: rotation(d) for d in centres}
        for b in batches:
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == d))
                code, r, s = encode(_vectors(part.column("x")), centres[d], turns[d])
                raw = [c.tobytes() for c in code]
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("dim"), part.column("x"), pa.array(raw, pa.binary()), pa.array(r), pa.array(s)], ["vec_id", "dim", "x", "code", "r", "s"])

    out = materialise(rows.mapInArrow(run, "vec_id long, dim int, x array<double>, code binary, r double, s double"), "codes")
    out._centres = centres
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of the index for each of the queries, rows of it or of another index.

    A row of the index with the query's own id is no candidate.
    """
    centres = index._centres
    slices = max(SLICES, -(-index.count() // SLICE))
    blocks = max(1, -(-queries.count() // BLOCK))
    key = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = index.select("dim", key("vec_id", slices).alias("slice"), every(blocks).alias("block"), "vec_id", "x", "code", "r", "s")
    right = queries.select("dim", every(slices).alias("slice"), key("vec_id", blocks).alias("block"), "vec_id", "x")

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        rows, asked = rows.combine_chunks(), asked.combine_chunks()
        d = rows.column("dim")[0].as_py()
        centre, turn = centres[d], rotation(d)
        of = lambda t, c: t.column(c).chunk(0)
        code = np.frombuffer(b"".join(of(rows, "code").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        held = Codes(*(of(rows, "vec_id").to_numpy(), _vectors(of(rows, "x")), code), of(rows, "r").to_numpy(), of(rows, "s").to_numpy(), centre)
        q = _vectors(of(asked, "x"))
        turned = np.zeros((len(q), len(turn)))
        turned[:, :d] = q - centre
        turned = turned @ turn.T
        shift = (q - centre) @ centre
        ids = of(asked, "vec_id").to_numpy()
        found = [held.best(int(i), *v, k) for i, *v in zip(ids, q, turned, shift, strict=True)]
        return pa.table([np.repeat(ids, [len(f[0]) for f in found]), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])], names)

    group = ["dim", "slice", "block"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, "query_id long, vec_id long, score double")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the rows of exact (query_id, vec_id) that are among found."""
    hit = exact.select("query_id", "vec_id").join(found.select("query_id", "vec_id").withColumn("_hit", F.lit(1)), ["query_id", "vec_id"], "left")
    return hit.agg(F.avg(F.coalesce("_hit", F.lit(0)))).first()[0]


# Exact neighbours; the query's codes lose none of them on the tables that are compared.
ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE len(embedding) > 0 AND NOT list_contains(list_transform(embedding, lambda y: y IS NULL OR NOT isfinite(y)), true) AND list_max(list_transform(embedding, lambda y: abs(y))) > 0),
p AS (SELECT q.vec_id AS query_id, o.vec_id, list_inner_product(q.x, o.x) AS score FROM v q JOIN v o ON q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
