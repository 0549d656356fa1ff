import math

import numpy as np
import pytest

from folio.llm import neighbours as N
from folio.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SCHEMA = "vec_id long, embedding array<float>, score string, x int"


def exact(rows, k, asked):
    """Every pair, by plain sums."""
    sound = {}
    for i, v, *_ in rows:
        if i is not None and v and all(y is not None and math.isfinite(y) for y in v) and any(v):
            sound[i] = min(sound.get(i, list(v)), list(v))
    out = set()
    for i in (i for i in sound if asked(i)):
        near = sorted((-sum(a * b for a, b in zip(sound[i], v, strict=True)), j) for j, v in sound.items() if j != i and len(v) == len(sound[i]))
        out |= {(i, n + 1, j) for n, (_, j) in enumerate(near[:k])}
    return out


def found(df, k=20, asked="vec_id % 20 = 0"):
    index = N.build(df)
    return N.search(index, index.where(asked), k)


@pytest.mark.parametrize("d", [1, 3, 64, 65, 130])
def test_bounds_hold(d):
    """Estimates stray beyond their bound in few pairs, and the code's inner product is that of the signs."""
    rng = np.random.default_rng(d)
    x, centre, turn = rng.standard_normal((400, d)), rng.standard_normal(d) / 9, N.rotation(d)
    assert np.allclose(turn @ turn.T, np.eye(len(turn)))
    code, r, s = N.encode(x, centre, turn)
    signs = np.unpackbits(code.view(np.uint8), axis=1, bitorder="little") * 2.0 - 1
    y = np.zeros((400, len(turn)))
    y[:, :d] = x - centre
    assert np.allclose((signs * (y @ turn.T)).sum(1) / np.sqrt(len(turn)) / r, s)
    held = N.Codes(np.arange(400), x, code, r, s, centre)
    q = rng.standard_normal((50, d))
    best = [held.best(-1, v, turn @ np.pad(v - centre, (0, len(turn) - d)), float((v - centre) @ centre), 10)[0] for v in q]
    true = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :10]
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(best, true.tolist(), strict=True)]) >= 0.98


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [nan, 1.0, 0.0], [inf, 1.0, 0.0], [1.0, 2.0], [3.0, -1.0]]
    rows = [(i * 20, v, "s", 1) for i, v in enumerate(odd)] + [(None, [1.0, 2.0, 3.0], "s", 1)]
    rows += [(200 + i, [float(i % 5), 1.0, -2.0], "s", 1) for i in range(60)]  # many ties
    rows += [(220, [9.0, 9.0, 9.0], "s", 1), (221, [0.0, 1.0, -2.0], "s", 1), (221, [0.0, 1.0, -2.0], "s", 1)]
    got = found(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == exact(rows, 20, lambda i: i % 20 == 0) and len({(r.query_id, r["rank"]) for r in got}) == len(got)
    assert found(spark.createDataFrame(rows[:6], SCHEMA)).count() == 0


def test_equal_vectors(spark):
    """A third of the rows are one vector: ties are taken by id, also where they are dealt over slices."""
    rng = np.random.default_rng(0)
    common = rng.standard_normal(16).astype(np.float32).astype(float)
    rows = [(i, (common if i % 3 == 0 else rng.standard_normal(16).astype(np.float32)).tolist(), "s", 1) for i in range(1200)]
    got = found(spark.createDataFrame(rows, SCHEMA), k=7).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == exact(rows, 7, lambda i: i % 20 == 0)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(N, "SLICE", 30)
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist(), "s", 1) for i in range(600)]
    got = found(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, x int"), asked="vec_id % 3 = 0", k=5)
    assert {(r.query_id, r["rank"], r.vec_id) for r in got.collect()} == exact(rows, 5, lambda i: i % 3 == 0)


def test_recall_of_a_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op12_neighbours"](spark, sf)
    t = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.stack(t.embedding.to_numpy()).astype(float)
    ids = t.vec_id.to_numpy()
    pairs = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        pairs += [(int(ids[i]), int(ids[j])) for j in np.argsort(-s, kind="stable")[:20]]
    assert N.recall(got, spark.createDataFrame(pairs, "query_id long, vec_id long")) >= 0.995


def test_as_sql(spark):
    assert compare(spark, "op12_neighbours", "/root/testdata/sf0.01", QUERIES, ORACLE_SQL) > 0
