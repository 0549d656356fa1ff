import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folio.llm import packing as P
from folio.llm.tokens import CachedEncoder, vocabulary

ODD = st.text(st.sampled_from("aAbsTÉÞ× éßÿ÷ΣΑ#$́\n\t\x1c\xa0\u0085İß1,.!'s<|endoftext|>漢😀"), max_size=40)


@settings(max_examples=200)
@given(st.lists(st.one_of(ODD, st.just("x <|endoftext|> y<|endoftext|>z")), max_size=4))
def test_encoder_as_library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    raw, at = CachedEncoder("word_bpe_49k.json", limit=3)(pa.array(texts, pa.string()))
    assert [np.frombuffer(memoryview(raw)[a:b], "<u4").tolist() for a, b in zip(at, at[1:], strict=False)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def plain_best_fit(lengths, cap, weight):
    bins, where = [], []
    for n in lengths:
        item = (n, 1, n * n)
        fits = [(sum(w * ((r - x) / c) ** 2 for w, r, x, c in zip(weight, b, item, cap, strict=True)), i) for i, b in enumerate(bins) if all(r >= x for r, x in zip(b, item, strict=True))]
        if fits:
            norm = min(fits)[0]
        else:
            bins.append(cap)
            norm, fits = None, [(None, len(bins) - 1)]
        where.append(([i for f, i in fits if f == norm or f is None], norm))
        i = where[-1][0][0]
        bins[i] = tuple(r - x for r, x in zip(bins[i], item, strict=True))
    return where, bins


@given(st.lists(st.integers(1, 20), min_size=1, max_size=40), st.integers(1, 5), st.integers(100, 400), st.sampled_from([P.WEIGHT, (1.0, 0.3, 0.2), (0.1, 1.0, 1.0)]))
def test_all_capacities_and_count(lengths, docs, cost, weight):
    cap = (20, docs, cost)
    lengths = sorted((n for n in lengths if n * n <= cost), reverse=True)
    where, offset = P.best_fit(lengths, cap, weight)
    by = defaultdict(list)
    for n, b, o in zip(lengths, where, offset, strict=True):
        by[b].append((o, n))
    for items in by.values():
        items.sort()
        assert [o for o, _ in items] == [sum(n for _, n in items[:i]) for i in range(len(items))]
        assert sum(n for _, n in items) <= 20 and len(items) <= docs and sum(n * n for _, n in items) <= cost
    assert len(by) == len(plain_best_fit(lengths, cap, weight)[1])
    with pytest.raises(ValueError):
        P.best_fit([21], cap)


@pytest.mark.parametrize("cap, least", [((100, 100, 10000), 10), ((100, 5, 10000), 20), ((100, 100, 500), 20), ((100, 2, 300), 50)])
def test_each_capacity_binds(cap, least):
    """100 pieces of 10 tokens: 10 fit by tokens, fewer by documents or by cost (100 each)."""
    where, _ = P.best_fit([10] * 100, cap)
    assert len(set(where)) == max(least, -(-100 // (cap[2] // 100)))


def test_weights_choose_the_bin():
    lengths = [16, 9, 8, 1]  # left for the last: 4 tokens beside one piece of 16, or 3 beside pieces of 9 and 8
    assert P.best_fit(lengths, (20, 3, 400), (1.0, 0.0, 0.0))[0][3] == 1
    assert P.best_fit(lengths, (20, 3, 400), (1.0, 0.0, 5.0))[0][3] == 0  # more of the cost is used there
    assert P.best_fit(lengths, (20, 3, 400), (0.1, 5.0, 0.0))[0][3] == 1  # more of the documents


def test_pack_documents(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["the", "Wort", "naïve", "x1", "..."]) for _ in range(rnd.choice([0, 3, 50, 900, 9000]))), "z") for i in range(60)]
    rows += [(60, None, "z"), (61, "", "z"), (0, rows[0][1], "z"), (None, "null id", "z")]
    got = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string")).collect()
    want = []
    for i, text, _ in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in got if r[0] is not None) == sorted(w for w in want if w[0] is not None) and len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for x in by.values():
        x.sort()
        assert all(a[0] + a[1] == b[0] for a, b in zip(x, x[1:], strict=False)) and x[0][0] == 0 and sum(n for _, n in x) <= 4096
    assert len(by) <= -(-sum(w[3] for w in want) // 4096) + 1
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    few = P.pack_documents(spark.createDataFrame(rows, "doc_id long, text string, length string"), max_docs=3).groupBy("sequence_id").count()
    assert max(r["count"] for r in few.collect()) == 3


def test_repeated_rows_split_over_shards(spark):
    got = P.pack(spark.range(1000).selectExpr("cast(null as long) as doc_id", "7 as length"), (70, 70, 4900), shard=100).collect()
    shards = defaultdict(set)
    for r in got:
        shards[r.sequence_id >> 32].add(r.sequence_id)
    assert len(got) == 1000 and len(shards) == 10 and max(map(len, shards.values())) <= 16


def test_as_few_sequences_as_tokens_allow(spark):
    got = P.pack_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert len({r.sequence_id for r in got}) == -(-sum(r.length for r in got) // 4096)
