import random
import re

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from folio.llm import chains as C


def plain_minimizers(g, w):
    out = set()
    for i in range(max(1, len(g) - w + 1)):
        part = g[i : i + w]
        out |= {i + k for k in range(len(part)) if part[k] == part.min()}
    return sorted(out)


@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 17))
def test_minimizers(g, w):
    g = np.array(g, np.uint64)
    assert C.minimizers(g, w).tolist() == (plain_minimizers(g, w) if len(g) else [])


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=25, unique=True))
def test_best_chain_is_optimal(points):
    x, y = np.array(points).T
    best = {}
    for i in sorted(range(len(points)), key=lambda i: (x[i], y[i])):
        best[i] = 16 + max([0, *(best[j] - 0.1 * (x[i] - x[j] + y[i] - y[j]) for j in best if x[j] < x[i] and y[j] < y[i])])
    got = C.chain(x, y)
    score = [16 * len(c) - 0.1 * (x[c[-1]] - x[c[0]] + y[c[-1]] - y[c[0]]) for c in got]
    assert sorted(i for c in got for i in c) == list(range(len(points)))
    assert max(score) == pytest.approx(max(best.values())) and score[0] == pytest.approx(max(score))
    for c in got:
        assert (np.diff(x[c]) > 0).all() and (np.diff(y[c]) > 0).all()


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(n)] for n in (60, 55, 200)]
    fuzzy = list(passages[2])
    for i in (20, 90, 140):
        fuzzy[i] = "changed"
    del fuzzy[160]
    rows, want = [], {}
    for i in range(40):
        t = [word() for _ in range(rnd.choice([30, 120]))]
        for p, members in enumerate([(3, 9, 17, 18), (4, 17), (5, 6)]):
            if i in members:
                body = fuzzy if p == 2 and i == 6 else passages[p]
                at = len(t) if p == 1 else rnd.randrange(len(t) + 1)  # none inside another
                t[at:at] = body
                if i != members[0]:
                    want[i, p] = body
        rows.append((i, " ".join(t), "x"))
    return rows, want


def test_passages(spark):
    rows, want = corpus()
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, seed string")).collect()
    assert {(r.doc_id, r.ref_doc_id) for r in got} == {(9, 3), (17, 3), (18, 3), (17, 4), (6, 5)}
    for r in got:
        text = rows[r.doc_id][1]
        span = text[r.start_char : r.start_char + r.n_chars].split()
        assert span == text.split()[r.start_word : r.start_word + r.n_words] and r.similarity >= 0.8
        best = max((len(set(span) & set(b)), len(b)) for (d, _), b in want.items() if d == r.doc_id)
        assert any(" ".join(b) in " ".join(span) for (d, _), b in want.items() if d == r.doc_id), best


def test_cut(spark):
    rows, want = corpus()
    df = spark.createDataFrame([(*r, len(r[1])) for r in rows] + [(100, None, "x", 0), (101, "", "x", 0), (None, rows[3][1], "x", 9)], "doc_id long, text string, _cuts string, n_chars long")
    out = C.cut_passages(df)
    assert out.columns == df.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) + 3 and got[100].text is None
    for i, t, _ in rows:
        left = got[i].text
        for (d, _), b in want.items():
            if d == i:
                assert " ".join(b[3:-3]) not in left
        if not any(d == i for d, _ in want):
            assert left == t
        else:
            assert got[i].n_chars == len(left) < len(t)


def test_copies_long_and_empty(spark):
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(20000))
    rows = [(i, text) for i in (7, 8, 9)] + [(8, text), (10, None), (11, "")]
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words, r.ref_doc_id) for r in got) == [(8, 0, 20000, 7), (9, 0, 20000, 7)]
    assert C.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_cut_of_no_rows(spark):
    out = C.cut_passages(spark.createDataFrame([], "doc_id long, text string, n_chars int, _row int"))
    assert out.columns == ["doc_id", "text", "n_chars", "_row"] and out.count() == 0


def replaced(parts, gaps, rnd):
    """A text of runs of words and its copy in which each stretch between two runs is replaced."""
    a, b = [], []
    for k, n in enumerate(parts):
        run = [rnd.randrange(1, 1 << 40) for _ in range(n)]
        a += run
        b += run
        if k < len(gaps):
            a += [rnd.randrange(1, 1 << 40) for _ in range(gaps[k])]
            b += [rnd.randrange(1, 1 << 40) for _ in range(gaps[k])]
    return np.array(a, np.uint64), np.array(b, np.uint64)


def plain_passage(parts, gaps, least=0.8, min_words=50):
    """Length of the longest segment of runs with the share and the words, by trying all."""
    best = 0
    for k in range(len(parts)):
        for m in range(k, len(parts)):
            equal = sum(parts[k : m + 1])
            words = equal + sum(gaps[k:m])
            if words >= min_words and equal >= least * words - 1e-9:
                best = max(best, words)
    return best


@pytest.mark.parametrize("parts, gaps", [([45, 45], [12]), ([30, 30], [8]), ([49, 20], [6]), ([25, 25, 25], [6, 6]), ([40, 8, 4], [1, 1])])
def test_replaced_stretch(parts, gaps):
    a, b = replaced(parts, gaps, random.Random(4))
    got = C.align(a, b, np.array([0]), np.array([0]))
    assert [(s, e, rs, re) for s, e, rs, re, _ in got] == [(0, len(a), 0, len(a))]
    assert got[0][4] == pytest.approx(sum(parts) / len(a))


@given(st.lists(st.tuples(st.integers(4, 60), st.integers(1, 14)), min_size=1, max_size=8), st.integers(0, 10**6))
def test_replaced_stretches_against_brute_force(runs, seed):
    parts, gaps = [r[0] for r in runs], [r[1] for r in runs[:-1]]
    a, b = replaced(parts, gaps, random.Random(seed))
    starts = np.cumsum([0, *(p + g for p, g in zip(parts, gaps, strict=False))])
    got = C.align(a, b, starts, starts)
    want = plain_passage(parts, gaps)
    assert bool(got) == bool(want)
    for s, e, rs, re, share in got:
        assert e - s >= 50 and share >= 0.8 - 1e-9 and (a[s:e] == b[rs:re]).mean() == pytest.approx(share)
    if want and min(parts) >= max(gaps, default=0):  # no end is mostly unequal
        assert max(e - s for s, e, *_ in got) == want


def test_ends_stay_close():
    rnd = random.Random(6)
    a, b = replaced([300, 4], [60], rnd)
    assert [g[:2] for g in C.align(a, b, np.array([0, 360]), np.array([0, 360]))] == [(0, 300)]


def sentence(n, rnd):
    return ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_passages_of_stock_lines(spark):
    """Passages whose lines stood singly, or two in a row, in earlier documents; against which pairs share 50 words."""
    rnd = random.Random(8)
    rows, want = [], set()
    for case in range(24):
        lines = [sentence(20, rnd) for _ in range(3 + case % 2)]
        base = len(rows)
        singles = lines if case % 3 else [x + y for x, y in zip(lines, lines[1:], strict=False)]
        for part in singles:
            rows.append((len(rows), " ".join(sentence(15, rnd) + part + sentence(15, rnd))))
        whole = [w for x in lines for w in x]
        for _ in range(2):
            rows.append((len(rows), " ".join(sentence(30, rnd) + whole + sentence(30, rnd))))
        want.add((len(rows) - 1, len(rows) - 2))
        assert base < len(rows)
    got = {(r.doc_id, r.ref_doc_id) for r in C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def plain_fuzzy(a, b, least=0.8, min_words=50):
    """Whether two lists of words hold a passage, words compared place by place."""
    return any((eq := [x == y for x, y in zip(a, b, strict=True)]) and sum(eq[i:j]) >= least * (j - i) - 1e-9 for i in range(len(a)) for j in range(i + min_words, len(a) + 1))


def test_fuzzy_passages(spark):
    """Short passages with every n-th word changed, at shares of 0.83 to 0.95."""
    rnd = random.Random(9)
    rows, want = [], set()
    for words, every in [(60, 12), (60, 8), (60, 7), (80, 8), (55, 15), (70, 20), (66, 6)]:
        for _ in range(12):
            body = sentence(words, rnd)
            other = [rnd.choice(["x", "y"]) * 7 if i % every == every - 1 else w for i, w in enumerate(body)]
            assert plain_fuzzy(body, other)
            for x in (body, other):
                rows.append((len(rows), " ".join(sentence(40, rnd) + x + sentence(40, rnd))))
            want.add((len(rows) - 1, len(rows) - 2))
    rows_ = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r.doc_id, r.ref_doc_id) for r in rows_}
    assert got <= want and len(got) >= 0.98 * len(want), f"FOUND {len(got & want)} of {len(want)}"
    assert all(r.similarity >= 0.8 and r.n_words >= 50 for r in rows_)


def test_long_words(spark):
    """Passages of words so long that their ends lie far, in characters, from the seeds."""
    rnd = random.Random(10)
    long = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([60, 200]))) for _ in range(n)]
    rows, want = [], []
    for k in range(10):
        body = long(50 + k)
        rows += [(2 * k, " ".join(long(70) + body + long(70))), (2 * k + 1, " ".join(long(80) + body + long(80)))]
        want.append((2 * k + 1, 80, len(body), 2 * k, 70))
    got = C.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.start_word, r.n_words, r.ref_doc_id, r.ref_start_word) for r in got) == want, f"FOUND {len(got)} of {len(want)}"


def test_rows_that_repeat_an_id(spark):
    """Each row keeps what is its own, whatever other rows have its id, and in either order of their texts."""
    rnd = random.Random(12)
    passage, own, other, more = (sentence(n, rnd) for n in (80, 100, 180, 90))
    for lead in ("a", "z"):  # the row with the passage comes first, or last, in the order of strings
        rows = [
            (1, " ".join([*sentence(30, rnd), *passage])),
            (2, " ".join([lead, *passage, *own])),
            (2, " ".join(["m", *other])),
            (None, " ".join(["n", *passage, *more])),
            (None, " ".join(["o", *other[:100], *sentence(20, rnd)])),
            (None, None),
            (2, None),
            (3, ""),
        ]
        rows += [rows[1], rows[3]]
        for kind, key in (("long", lambda i: i), ("string", lambda i: None if i is None else f"d{i}"), ("int", lambda i: i)):
            data = [(key(i), t, 0 if t is None else len(t)) for i, t in rows]
            out = C.cut_passages(spark.createDataFrame(data, f"doc_id {kind}, text string, n_chars long").repartition(3))
            cut = {(2, rows[1][1]): " ".join([lead, "", *own]), (None, rows[3][1]): " ".join(["n", "", *more]), (None, rows[4][1]): " ".join(["o", "", *rows[4][1].split()[101:]])}
            want = [(key(i), t if (i, t) not in cut else cut[i, t]) for i, t in rows]
            order = lambda x: (x[0] is None, str(x[0]), x[1] is None, x[1] or "")
            assert sorted([(r.doc_id, r.text) for r in out.collect()], key=order) == sorted(want, key=order)
            assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_white_space_outside_passages_stays(spark):
    rnd = random.Random(13)
    body = " ".join(sentence(60, rnd))
    rows = [(1, body), (2, f"  \n one two\t{body}\n three \n"), (3, f"\n{body} ")]
    got = {r.doc_id: r.text for r in C.cut_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: body, 2: "  \n one two\t\n three \n", 3: "\n "}


def plain_share(a, b):
    """Longest common subsequence of two lists of words, by the longer of them."""
    ids = {w: i for i, w in enumerate(set(a) | set(b))}
    b = np.array([ids[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        row = np.maximum.accumulate(np.maximum(row, np.append(0, row[:-1] + (b == ids[w]))))
    return row[-1] / max(len(a), len(b))


def test_whole_table_against_brute_force(spark):
    """Of all words in windows of 50 that an earlier document holds too, and of what is reported, on a whole table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = {r.doc_id: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")] for r in docs.collect()}
    found = {i: np.zeros(len(w), bool) for i, w in words.items()}
    rows = C.repeated_passages(docs).collect()
    for r in rows:
        a, b = (words[i][s : s + n] for i, s, n in ((r.doc_id, r.start_word, r.n_words), (r.ref_doc_id, r.ref_start_word, r.ref_n_words)))
        assert r.ref_doc_id < r.doc_id and min(len(a), len(b)) >= 50
        if len(a) * len(b) < 1 << 22:
            assert plain_share(a, b) >= 0.8 - 1e-9
        found[r.doc_id][r.start_word : r.start_word + r.n_words] = True
    first, total, missed = {}, 0, 0
    for i in sorted(words):
        held = np.zeros(len(words[i]), bool)
        windows = [tuple(words[i][k : k + 50]) for k in range(len(words[i]) - 49)]
        for k, w in enumerate(windows):
            if first.setdefault(w, i) < i:
                held[k : k + 50] = True
        total += held.sum()
        missed += (held & ~found[i]).sum()
    assert total > 10_000 and missed <= 0.005 * total, f"MISSED {missed} of {total}"
