import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from folio.llm import simhash as S


def plain_fp(text, k=3):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(ids, fps, radius=2):
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(len(ids)):
        least[find(i)].append(ids[i])
    return [min(least[find(i)]) for i in range(len(ids))]


@given(st.text(st.sampled_from("aAbÉ \n\t\x0b\x1c\xa0"), max_size=40))
def test_fingerprint(text):
    assert S.fingerprint(text) == plain_fp(text)


@given(st.integers(0, 9), st.integers(0, 10**6))
def test_within(radius, seed):
    r = np.random.default_rng(seed)
    lanes = r.integers(0, 1 << 63, (3, 64), dtype=np.uint64)
    lanes[:, 1:40] = lanes[:, :1] ^ (np.uint64(1) << r.integers(0, 64, (3, 39), dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, (3, 39), dtype=np.uint64))
    q = lanes[:, 0] ^ np.uint64(5)
    got = S.within(S.planes_of(lanes), q, radius)
    want = [sum(1 << i for i in range(64) if bin(int(lanes[k, i]) ^ int(q[k])).count("1") <= radius) for k in range(3)]
    assert got.tolist() == want


@pytest.mark.parametrize("block", [4096, 3])
def test_near_groups(spark, block):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows, n = [], 0
    for g in range(12):
        base = [rnd.choice(words) for _ in range(rnd.choice([2, 40, 400]))]
        for _ in range(rnd.choice([1, 3, 9])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append((n, " ".join(t), "extra"))
            n += 1
    rows += [(n, None, "x"), (n + 1, "", "x"), (n + 2, " \n", "x"), (n + 3, rows[0][1], "x"), (n + 3, rows[0][1], "x"), (n + 4, "q " * 70000, "x")]
    got = S.near_groups(spark.createDataFrame(rows, "doc_id long, text string, node string"), block=block).collect()
    fps = [plain_fp(t) if len(t or "") < 10**5 else S.fingerprint(t) for _, t, _ in rows]
    want = plain_components([r[0] for r in rows], fps)
    assert sorted(map(tuple, got)) == sorted((r[0], f"{f:016x}", c) for r, f, c in zip(rows, fps, want, strict=True))


def test_link_splits_hot_blocks(spark):
    base = 0x0123456789ABCDEF
    fps = sorted({base ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i)})
    rows = [(f, f) for f in fps]
    edges = S.link(spark.createDataFrame(rows, "node long, fp long"), block=16).collect()
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        assert bin(u ^ v).count("1") <= 2
        parent[find(u)] = find(v)
    assert len({find(f) for f in fps}) == 1


def test_empty_and_nulls(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_groups(none).count() == 0 and S.drop_near_duplicates(none).count() == 0
    got = S.near_groups(spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (None, "z")], "doc_id long, text string")).collect()
    assert sorted((str(r[0]), str(r[2])) for r in got) == [("3", "3"), ("None", "3"), ("None", "None")]


@pytest.mark.parametrize("block", [4096, 2])
def test_similar_groups(spark, block):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows, want = [], []
    for g in range(30):
        base = [rnd.choice(words) for _ in range(200)]
        first = len(rows)
        for k in range(4):
            t = list(base)
            if k:
                t[50 * k] = "other"
            rows.append((len(rows), " ".join(t), k))
            want.append(first)
    got = dict(map(tuple, S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, fp int"), block=block).collect()))
    assert [got[i] for i in range(len(rows))] == want
    kept = S.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int"))
    assert kept.columns == ["doc_id", "text", "fp"] and sorted(r[0] for r in kept.collect()) == sorted(set(want))


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.sampled_from([8, 100]))
def test_jaccard(a, b, k):
    was, S.SKETCH = S.SKETCH, k
    try:
        got, exact = S.jaccard(*(np.array(sorted(x)[:k], np.uint32) for x in (a, b)))
    finally:
        S.SKETCH = was
    want = len(a & b) / len(a | b) if a | b else 1.0
    if exact:
        assert got == want
    least = sorted(a | b)[:k]
    assert exact or got == sum(x in a and x in b for x in least) / len(least)


def test_similar_groups_with_repeated_lines(spark):
    """Pairs that differ in how often a line stands in them; shingles are counted once."""
    rnd = random.Random(5)
    rows = []
    for _ in range(40):
        base, foot = [f"w{rnd.randrange(10**6)}" for _ in range(600)], [f"f{rnd.randrange(10**6)}" for _ in range(8)]
        for n in (1, 40):
            rows.append((len(rows), " ".join(base + foot * n)))
    got = dict(map(tuple, S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    found = sum(got[i] == got[i + 1] == i for i in range(0, len(rows), 2))
    assert found == 40, f"FOUND {found} of 40"


def test_similar_groups_of_long_texts(spark):
    """Texts of over 1024 shingles at similarities on either side of 0.8, against the whole sets."""
    rnd = random.Random(6)
    rows, want = [], []
    for k in range(40):
        n = 1600 + 10 * k
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        share = 0.79 if k % 2 else 0.81
        cut = round((n - 4) * (1 - share) / (1 + share)) - 4  # a stretch replaced at the end
        other = base[: n - cut] + [f"o{rnd.randrange(10**6)}" for _ in range(cut)]
        a, b = ({tuple(x[i : i + 5]) for i in range(n - 4)} for x in (base, other))
        want.append(len(a & b) / len(a | b) >= 0.8)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(other))]
    got = dict(map(tuple, S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    right = sum((got[2 * k + 1] == 2 * k) == want[k] for k in range(40))
    assert 10 < sum(want) < 30 and right == 40, f"RIGHT {right} of 40, {sum(want)} alike"


def test_similar_groups_of_a_whole_table(spark):
    """All pairs of a table at 0.8 or more, by whole sets of word 5-grams, give the same components."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders = {}, {}
    for r in docs.collect():
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")]
        k = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}
        for g in sets[r.doc_id]:
            holders.setdefault(g, []).append(r.doc_id)
    common = {}
    for g in holders.values():
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            pairs += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert pairs > 50
    assert {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()} == {i: find(i) for i in sets}


@pytest.mark.parametrize("similarity", [0.4, 0.5, 0.65])
def test_similar_groups_under_the_default(spark, similarity):
    """Bands follow the similarity: all pairs of a table, by whole sets of word 5-grams, give the same components."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets, holders, common = {}, defaultdict(list), defaultdict(int)
    for r in docs.collect():
        w = re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split()
        k = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else {()}
        for g in sets[r.doc_id]:
            holders[g].append(r.doc_id)
    for g in holders.values():
        for i, a in enumerate(g):
            for b in g[i + 1 :]:
                common[a, b] += 1
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    lower = 0
    for (a, b), n in common.items():
        share = n / (len(sets[a]) + len(sets[b]) - n)
        if share >= similarity:
            lower += share < 0.8
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert lower > 30
    assert {r.doc_id: r.component_id for r in S.similar_groups(docs, similarity=similarity).collect()} == {i: find(i) for i in sets}


def test_similar_groups_of_a_long_text_and_its_part(spark):
    """Under 0.5 a text of over 1024 shingles is alike to parts of under 512; whole sets settle both sides of 0.4."""
    rnd = random.Random(9)
    rows, want = [], []
    for k in range(40):
        n = 1030 + 5 * k
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        part = base[: round(0.4 * (n - 4)) + 4 + (5 if k % 2 else -5)]
        want.append((len(part) - 4) / (n - 4) >= 0.4)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(part))]
    got = dict(map(tuple, S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), similarity=0.4).collect()))
    right = sum((got[2 * k + 1] == 2 * k) == want[k] for k in range(40))
    assert sum(want) == 20 and right == 40, f"RIGHT {right} of 40"


@pytest.mark.parametrize("similarity", [0.1, 0.3, 0.4, 0.5, 0.8, 0.95, 1.0])
def test_bands(similarity):
    bands, rows = S.bands_of(similarity)
    assert bands * rows <= S.SLOTS and (1 - similarity**rows) ** bands <= S.MISSED
    assert [S.bands_of(0.8), S.radius_of(0.8), round(S.margin_of(0.8), 9)] == [(24, 5), 32, 0.06]
    with pytest.raises(ValueError, match="too low"):
        S.bands_of(0.01)
