import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import pieces as P
from folio.llm.tokens import vocabulary

TEXT = st.text(st.sampled_from("ab thein  \n.=-▁é漢😀1"), min_size=1, max_size=60)


def scan(m, text, size):
    """Chunks, matrices, boundaries and traces in one process."""
    x = m.normal(text)
    parts = max(1, -(-len(x) // size))
    chunks = []
    for p in range(parts):
        lo, hi = p * size, min(len(x), (p + 1) * size)
        a, z = max(0, lo - m.longest), min(len(x), hi + m.longest)
        chunks.append(P.Chunk(m, x[a:z], lo - a, hi - a, p == 0, p == parts - 1))
    s = P.boundaries([c.matrix() for c in chunks], 0, 0)
    return np.frombuffer(b"".join(c.ids(a, b) for c, a, b in zip(chunks, s, s[1:], strict=False)), "<u4").tolist()


@settings(deadline=None, max_examples=60)
@given(st.lists(TEXT, min_size=1, max_size=12), st.sampled_from([17, 20, 64]))
def test_bpe_as_library(texts, size):
    m = P.model("piece_bpe_32k.model")
    text = "".join(texts)
    assert scan(m, text, size) == m.library.encode(text)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.one_of(TEXT, st.just(""), st.just("x" * 70 + " y x y")), max_size=5))
def test_whole_as_library(texts):
    m = P.model("piece_bpe_32k.model")
    raw = m.whole(pa.array(texts, pa.string()), limit=5).to_pylist()
    ids = m.library.encode(texts)
    assert m.by_word and [np.frombuffer(x, "<u4").tolist() for x in raw] == ids
    assert [x.decode() for x in m.texts(raw, [0] * len(raw))] == [m.library.decode(x) for x in ids]


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12), max_size=4))
def test_texts_as_library(ids):
    """Any ids at all: bytes that are no characters, unknown and control pieces, pieces that begin with a space."""
    m = P.model("piece_bpe_32k.model")
    raw = [np.array(x, "<u4").tobytes() for x in ids]
    assert [x.decode() for x in m.texts(raw, [0] * len(raw))] == [m.library.decode(x) for x in ids]


def unigram():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40000) / 1000
    return P.Model(proto.SerializeToString())


@settings(deadline=None, max_examples=40)
@given(st.lists(TEXT, min_size=1, max_size=12), st.sampled_from([17, 64]))
def test_unigram_is_optimal(texts, size):
    m = test_unigram_is_optimal.model
    x = m.normal("".join(texts))
    best = [0.0] + [-np.inf] * len(x)
    for j in range(1, len(x) + 1):
        for k in range(1, min(16, j) + 1):
            p = x[j - k : j]
            if p in m.score or k == 1:
                best[j] = max(best[j], best[j - k] + m.score.get(p, m.unknown))
    back = {i: p for p, i in m.id.items()}
    got = scan(m, "".join(texts), size)
    total, held = 0.0, 0
    for i in got:
        if i in back:
            total += m.score[back[i]]
        else:
            held += 1
    unknown = sum(1 for c in x if c not in m.id)
    assert total + unknown * m.unknown == pytest.approx(best[-1]) and held == sum(len(c.encode()) for c in x if c not in m.id)
    assert m.library.decode(got) == "".join(texts).replace("▁", " ")


test_unigram_is_optimal.model = unigram()


def test_products_are_associative():
    r = np.random.default_rng(1)
    a, b, c = (np.where(r.random(s) < 0.3, -np.inf, r.integers(0, 9, s).astype(float)) for s in ((3, 4), (4, 2), (2, 5)))
    assert np.array_equal(P.times(P.times(a, b), c), P.times(a, P.times(b, c)))


@pytest.mark.parametrize("group", [2, 64])
def test_spark(spark, group):
    rnd = random.Random(6)
    long = "".join(rnd.choice(["the ", "thein", "é", "\n", "  ", "xyzzy", "===", "漢字"]) for _ in range(900))
    texts = [None, "", "short text", long, "=" * 1500, "thein" * 300, long]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)] + [(None, long, "z")], "doc_id long, text string, key string")
    enc = P.encode(df.repartition(2), chunk=128, group=group).cache()
    m = P.model("piece_bpe_32k.model")
    by, back = defaultdict(list), defaultdict(list)
    for r in enc.collect():
        by[r.doc_id, r.key].append((r.part, np.frombuffer(r.ids, "<u4").tolist()))
    for r in P.decode(enc).collect():
        back[r.doc_id, r.key].append((r.part, r.text))
    assert len(by) == 8 and max(len(v) for v in by.values()) > 5
    for (i, key), v in by.items():
        t = long if i is None else texts[i] or ""
        assert sum((x for _, x in sorted(v)), []) == m.library.encode(t)
        assert "".join(x for _, x in sorted(back[i, key])) == t
    assert P.digest(P.encode(df.limit(0))).count() == 0
    assert P.digest(enc).count() == enc.count()


def test_whole_table_as_library(spark):
    """Every row of a whole table, with chunks so short that most texts have several, against the library."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    by = defaultdict(list)
    for r in P.encode(docs, chunk=512).collect():
        by[r.doc_id].append((r.part, np.frombuffer(r.ids, "<u4").tolist()))
    m = P.model("piece_bpe_32k.model")
    rows = docs.collect()
    assert sum(len(v) > 1 for v in by.values()) > len(rows) / 2
    for r in rows:
        assert sum((x for _, x in sorted(by[r.doc_id])), []) == m.library.encode(r.text or "")


def test_keys_are_those_of_each_evaluation(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    enc = P.encode(docs, chunk=512)
    one, two = ({(r.doc_id, r.key, r.part) for r in enc.select("doc_id", "key", "part").collect()} for _ in range(2))
    assert one == two and len({k for _, k, _ in one}) == docs.count()


def test_kept_words_are_bounded():
    """Memory of a worker: two generations of words, whatever the number of different ones, and the same ids after they turned."""
    m = P.Model(open(P.vocabulary("piece_bpe_32k.model"), "rb").read())
    texts = [" ".join(f"w{i}" for i in range(a, a + 20_000)) for a in range(0, 200_000, 20_000)]
    first = m.whole(pa.array(texts[:1])).to_pylist()
    for t in texts:
        m.whole(pa.array([t]))
    assert len(m.words) + len(m.older) <= 2 * 70_000 and m.whole(pa.array(texts[:1])).to_pylist() == first
