import hashlib
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folio.llm import infill as I
from folio.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

MIXED = st.text(st.one_of(st.sampled_from("abZ <>PSM.9\n"), st.characters(exclude_categories=["Cs"])), max_size=80)


def plainly(text, key, plain=10, spm=20):
    """The rewriting by regular expression and slices of lists."""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    h = [int(hashlib.sha256(key.encode()).hexdigest()[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(MIXED, st.integers(0, 10**6))
def test_as_by_regular_expression(text, key):
    *rest, out = I.rewrite(text.encode(), f"1:{key}")
    assert (*rest, out.decode()) == plainly(text, f"1:{key}")


@given(st.lists(st.booleans(), max_size=300), st.integers(0, 310))
def test_select(bits, k):
    at = [i for i, x in enumerate(bits) if x]
    assert I.select(sum(1 << i for i in at), len(bits), k) == (at[k] if k < len(at) else len(bits))


def test_bytes_that_are_no_text():
    raw = b"ab\xff\xc3(c\x80"
    n, form, p, m, out = I.rewrite(raw, "1:1", plain=0, spm=0)
    prefix, rest = out[3:].split(b"<S>")
    suffix, middle = rest.split(b"<M>")
    assert form == "psm" and prefix + middle + suffix == raw


def test_rows(spark):
    texts = [None, "", "a", "ab cd", "ab cd", "<S> in it", "é" * 3, "中文 text", "x" * 300_000, "word and 9 " * 30_000, "<" * 50, ">" * 50, "\0\n\r\t"]
    rows = [(i, t, "n", 1) for i, t in enumerate(texts * 6)]
    df = spark.createDataFrame([*rows, (None, "no id", "n", 1), (3, "ab cd", "n", 1)], "doc_id long, text string, form string, _key int")
    made = I.transform(df.repartition(3))
    got = I.digest(made).collect()
    assert len(got) == len(rows) + 2 and {r.form for r in got} == {"plain", "psm", "spm"}
    by_id = {r[0]: r[1] for r in rows}
    for r in got:
        text = "no id" if r.doc_id is None else by_id[r.doc_id] or ""
        *rest, out = plainly(text, f"1:{'' if r.doc_id is None else r.doc_id}")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == tuple(rest)
        assert r.output_sha256 == hashlib.sha256(out.encode()).hexdigest() and r.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert I.transform(df.limit(0)).count() == 0
    assert {r.form for r in I.transform(df.withColumn("doc_id", df.doc_id.cast("string")), seed=2, plain=0, spm=100).collect()} == {"plain", "spm"}


def test_no_shuffle(spark):
    plan = QUERIES["op11_infill"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_as_sql(spark, sf):
    assert compare(spark, "op11_infill", f"/root/testdata/{sf}", QUERIES, ORACLE_SQL) > 0
