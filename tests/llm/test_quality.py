import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folio.llm import quality as Q
from folio.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

W = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    w = W.findall(text or "")
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(tri)
    covered = {i + j for i, t in enumerate(tri) if c[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(covered)


def texts():
    rnd = random.Random(4)
    out = [None, "", " \n\t", "one", "a b", "a b c", "a b a b a b", "x x x x x x", "é😀 ### a\n \n### a\n### a\r\n", "a\x0bb\x1cc d", "w " * 5000]
    for _ in range(60):
        words = [rnd.choice(["a", "b", "cc", "d#", "é"]) for _ in range(rnd.choice([3, 10, 60, 300]))]
        out.append(rnd.choice([" ", "\n", "  "]).join(words))
    return out


@pytest.mark.parametrize("low", [None, (1 << 62) - 1])
def test_counts(spark, low, monkeypatch):
    if low:
        monkeypatch.setattr(Q, "_LOW", 7)  # clashes and overflows: the sort of whole hashes
    rows = [(i, t, 5) for i, t in enumerate(texts())]
    got = {r.doc_id: tuple(r[c] for c in Q.COUNTS) for r in Q.counted(spark.createDataFrame(rows, "doc_id long, text string, n_words int")).collect()}
    for i, t, _ in rows:
        assert got[i] == plain(t), repr(t)[:80]


def test_fences_adapt(spark):
    rnd = random.Random(1)
    word = lambda n: "".join(rnd.choice("abcdefghijk") for _ in range(n))
    rows = []
    for s, size in (("short", 4), ("long", 9)):
        for i in range(60):
            rows.append((len(rows), " ".join(word(size + rnd.choice([-1, 0, 1])) for _ in range(80)), "en", s, "kept"))
        rows.append((len(rows), " ".join(word(13 - size) for _ in range(80)), "en", s, "gone"))
        rows.append((len(rows), " ".join(word(size) + "###" for _ in range(80)), "en", s, "gone"))
    rows.append((len(rows), " ".join(word(5) for _ in range(80)), None, None, "kept"))
    rows.append((len(rows), None, "en", "short", "gone"))
    rows += rows[-3:-1]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    assert {(r.doc_id, r.kept) for r in Q.judge(df).collect()} == {(r[0], r[4] == "kept") for r in rows}
    out = Q.filter_documents(df)
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == sorted(r[0] for r in rows if r[4] == "kept")
    none = spark.createDataFrame([], df.schema)
    assert Q.judge(none).count() == 0 and Q.filter_documents(none).count() == 0


@pytest.mark.parametrize("share", list(Q.SHARES))
@pytest.mark.parametrize("key", ["lang", "source"])
def test_every_fence_moves_with_its_group(spark, share, key):
    """The same counts pass where the group is like that and fail where it isn't, for each share, language and source."""
    x = Q.SHARES[share][0]
    rnd = random.Random(3)
    usual = {"n_words": 2000, "word_chars": 10000, "n_symbols": 50, "n_lines": 2000, "n_dup_lines": 20, "n_repeat_words": 40}

    def row(i, group, times):
        c = dict(usual)
        c[x] = round(usual[x] * times)
        if share == "word_length":
            c["n_symbols"] = round(usual["n_symbols"] * times)
        return (i, *((group, "s") if key == "lang" else ("l", group)), *(c[k] for k in Q.COUNTS))

    loud, quiet = (2.0, 1.0) if share == "word_length" else (10.0, 1.0)
    rows = [row(i, g, t * rnd.uniform(0.95, 1.05)) for i, (g, t) in enumerate([("loud", loud), ("quiet", quiet)] * 300)]
    rows += [row(1000, "loud", loud), row(1001, "quiet", loud), row(1002, "quiet", quiet)]
    counts = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in Q.COUNTS)).coalesce(2)
    got = {r.doc_id: r.kept for r in Q._judged(counts, Q.fences(counts)).collect()}
    assert got.pop(1000) and not got.pop(1001) and got.pop(1002) and all(got.values())


def test_fences_of_a_whole_table(spark):
    """Each document that is labelled junk goes and each that is labelled good stays; word lengths alone find half of the junk."""
    sf = "/root/testdata/sf0.1"
    counts = Q.counted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")).drop("text").cache()
    x = Q._fenced(counts, Q.fences(counts)).where(~Q.base_failed())
    x = x.select("doc_id", *(F.coalesce(v, F.lit(False)).alias(k) for k, v in Q.outside().items())).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    found = {r.quality: r for r in x.groupBy("quality").agg(F.count("*").alias("n"), F.count_if(F.expr(" or ".join(Q.outside()))).alias("out"), *(F.count_if(k).alias(k) for k in Q.outside())).collect()}
    assert found[1].n > 3000 and found[1].out == 0
    assert found[0].n > 200 and found[0].out == found[0].n and found[0].word_length_high + found[0].word_length_low >= found[0].n / 2
    counts.unpersist()


def test_verdicts_move_with_the_source_of_a_whole_table(spark):
    """Half of the sources get a sign after every second word: there it is usual, and a text like that stays; a text of
    theirs under the name of a quiet source goes, as no constant could have it."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "lang", "source")
    before = Q.judge(d).select("doc_id", F.col("kept").alias("was"))
    loud = F.substring("source", 4, 2).cast("int") % 2 == 0
    moved = loud & (F.floor(F.col("doc_id") / 20) % 20 == 1)
    signs = F.regexp_replace("text", r"((?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]+){2})", "$1# ")
    changed = d.withColumns({"text": F.when(loud, signs).otherwise(F.col("text")), "source": F.when(moved, "quiet").when(loud, "loud").otherwise("quiet"), "moved": moved})
    after = Q.judge(changed).join(changed.select("doc_id", "moved"), "doc_id").join(before, "doc_id").where("was and n_words >= 100")
    n = {(r.source, r.moved): (r.n, r.kept) for r in after.groupBy("source", "moved").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()}
    assert n["loud", False][0] > 2000 and n["loud", False][1] >= 0.999 * n["loud", False][0]
    assert n["quiet", False][1] >= 0.999 * n["quiet", False][0]
    assert n["quiet", True][0] > 100 and n["quiet", True][1] <= 0.02 * n["quiet", True][0]


def test_sql(spark):
    assert compare(spark, "op1_quality", "/root/testdata/sf0.01", QUERIES, ORACLE_SQL) == 1000


def test_no_python_in_plan(spark):
    df = Q.filter_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
