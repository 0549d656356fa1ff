import glob
import json
import os
import subprocess
import sys

import pytest

from jobs import _common, inbox, worklist
from jobs.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, uses int, ord string"
PAGE = "page_id long, url string, html string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_as_sql(spark, name):
    assert compare(spark, name, SF, QUERIES, ORACLE_SQL) > 0


# --- work list ------------------------------------------------------------------------------------------------------


def listed(spark, out):
    return sorted(((r.lang, r.text, r.uses, r.doc_id, r.ord) for r in worklist.result(spark, out).collect()), key=str)


def test_worklist_of_odd_rows(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    rows = [(1, "First line.\n\n12\n1234 5\nSame line.", "en"), (2, "Same line.\nSame line.", "en"), (None, "Same line.", None), (3, None, "en"), (4, "", "de"), (5, "word " * 2000 + "end.", "de"), (5, "word " * 2000 + "end.", "de")]
    spark.createDataFrame([(*r, 7, "x") for r in rows], DOC).write.parquet(docs)
    worklist.run(spark, docs, out, _common.config("worklist"))
    got = listed(spark, out)
    assert [g for g in got if g[0] == "en"] == [("en", "First line.", 1, 1, 1), ("en", "Same line.", 3, 1, 5)]
    assert (None, "Same line.", 1, None, 1) in got
    long = [g for g in got if g[0] == "de"]
    assert all(len(g[1]) <= 2800 and g[2] % 2 == 0 for g in long) and sum(g[2] * len(g[1].split()) for g in long) == 4002
    worklist.run(spark, docs, out, _common.config("worklist"))
    assert listed(spark, out) == got
    spark.createDataFrame([], DOC).write.mode("overwrite").parquet(docs)
    worklist.run(spark, docs, out, _common.config("worklist"))
    assert listed(spark, out) == []


def test_worklist_of_some_languages(spark, tmp_path):
    """A run for one language leaves the partitions of the others, and done units stay out."""
    docs, out, done = (f"{tmp_path}/{x}" for x in ("docs", "out", "done"))
    spark.createDataFrame([(1, "Eins alleine\nZwei zusammen", "de", 0, ""), (2, "One alone", "en", 0, "")], DOC).write.parquet(docs)
    worklist.run(spark, docs, out, _common.config("worklist"))
    spark.createDataFrame([(1, "Neue Zeile\nZwei zusammen", "de", 0, ""), (2, "Another line", "en", 0, "")], DOC).write.mode("overwrite").parquet(docs)
    worklist.result(spark, out).where("text = 'Zwei zusammen'").select("lang", "text_id").write.parquet(done)
    worklist.run(spark, docs, out, _common.config("worklist") | {"languages": ["de"]}, done)
    assert [g[:2] for g in listed(spark, out)] == [("de", "Neue Zeile"), ("en", "One alone")]


def test_requests(spark, tmp_path):
    docs, out = f"{tmp_path}/docs", f"{tmp_path}/out"
    spark.createDataFrame([(1, "One alone", "en", 0, "")], DOC).write.parquet(docs)
    worklist.run(spark, docs, out, _common.config("worklist") | {"style": "anthropic", "model": "m", "system": "brief"})
    (r,) = worklist.result(spark, out).collect()
    body = json.loads(r.body)
    assert r.url.endswith("/messages") and body["model"] == "m" and body["system"] == "brief" and json.dumps([{"id": r.text_id, "text": "One alone"}], separators=(",", ":")) in body["messages"][0]["content"]
    worklist.run(spark, docs, out, _common.config("worklist") | {"style": "unsupported"})
    assert [(x.url is None, x.body is None, x.error is None) for x in worklist.result(spark, out).collect()] == [(True, True, False)]


# --- inbox ----------------------------------------------------------------------------------------------------------


def by_hand(spark, batches):
    """Paragraphs and the first to show each, batch after batch, by loops."""
    seen, out = set(), set()
    for n, rows in enumerate(batches):
        found = {r[:4] + (r.text,) for r in inbox.paragraphs(spark.createDataFrame(rows, PAGE)).select(*inbox.PLACE, "text").collect()}
        first = {}
        for page, ord_, host, text_id, _ in sorted(found, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
            first.setdefault((host, text_id), (page, ord_))
        for page, ord_, host, text_id, text in found:
            new = (host, text_id) not in seen and first[host, text_id] == (page, ord_)
            out.add((page, ord_, host, text_id, new, text if new else None, n))
        seen |= set(first)
    return out


def shown(spark, out):
    rows = inbox.result(spark, out).select(*inbox.PLACE, "is_new", "text", "batch").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_inbox_over_growing_input(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").orderBy("page_id").collect()
    odd = [(None, "https://a.example/x", "<p>Hello there</p>"), (None, "https://A.example/y", "<p>Hello there</p><p>1 2 3</p>"), (900, None, "<p>Hello there</p>"), (901, "no scheme", "<p>Hello there</p>"), (902, "https://a.example", None), (903, "https://a.example?q", "<p>Hello there</p>")]
    batches = [[*map(tuple, pages[:30]), *odd[:3], odd[0]], [*map(tuple, pages[20:]), *odd[2:]]]
    inp, out, mark = (f"{tmp_path}/{x}" for x in ("pages", "out", "mark"))
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, PAGE).coalesce(1).write.mode("append").parquet(inp)
        inbox.run(spark, inp, out, mark, _common.config("inbox"))
        assert shown(spark, out) == by_hand(spark, batches[: n + 1])
    inbox.run(spark, inp, out, mark, _common.config("inbox"))  # nothing has come
    assert shown(spark, out) == by_hand(spark, batches)
    inbox.take(spark.createDataFrame(batches[0], PAGE), out, 0)  # batches that are run again
    inbox.take(spark.createDataFrame(batches[1], PAGE), out, 1)
    assert shown(spark, out) == by_hand(spark, batches)


def test_inbox_goes_on_after_a_failure(spark, tmp_path, monkeypatch):
    """A batch that fails after its write is taken again by the next run, with the same result."""
    inp, out, mark = (f"{tmp_path}/{x}" for x in ("pages", "out", "mark"))
    rows = [(i, f"https://h{i % 3}.example/", f"<p>Menu of the site</p><p>Page number {'x' * i}</p>") for i in range(20)]
    spark.createDataFrame(rows, PAGE).repartition(4).write.parquet(inp)
    take, failed = inbox.take, []

    def once(df, output, n):
        take(df, output, n)
        if n == 1 and not failed:
            failed.append(n)
            raise RuntimeError("lost")

    monkeypatch.setattr(inbox, "take", once)
    with pytest.raises(Exception, match="lost"):
        inbox.run(spark, inp, out, mark, {"max_files": 1})
    inbox.run(spark, inp, out, mark, {"max_files": 1})
    got = shown(spark, out)
    assert {r[6] for r in got} == {0, 1, 2, 3} and len(got) == 40 and sum(r[4] for r in got) == 3 + 20
    assert {r[0] for r in got} == set(range(20))


def test_empty_inbox(spark, tmp_path):
    os.makedirs(f"{tmp_path}/pages")
    inbox.run(spark, f"{tmp_path}/pages", f"{tmp_path}/out", f"{tmp_path}/mark", _common.config("inbox"))
    assert inbox.result(spark, f"{tmp_path}/out").count() == 0


# --- command lines --------------------------------------------------------------------------------------------------


def test_command_lines(spark, tmp_path):
    more = tmp_path / "more.json"
    more.write_text(json.dumps({"languages": ["en"]}))
    calls = [("worklist", "--documents", f"{SF}/documents.parquet", "--output", f"{tmp_path}/w", "--config", str(more)), ("inbox", "--pages", f"{SF}/pages.parquet*", "--output", f"{tmp_path}/i", "--checkpoint", f"{tmp_path}/c")]
    for name, *args in calls:
        env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
        done = subprocess.run([sys.executable, "-m", f"jobs.{name}", *args], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0 and f"jobs.{name} read" in done.stderr, done.stderr[-2000:]
    assert [os.path.basename(p) for p in glob.glob(f"{tmp_path}/w/lang=*")] == ["lang=en"]
    assert inbox.result(spark, f"{tmp_path}/i").count() > 0


def test_settings(tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text('{"langauges": []}')
    with pytest.raises(ValueError, match="langauges"):
        _common.config("worklist", str(bad))
