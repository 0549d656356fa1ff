"""Work that grows no faster than the input: what the plans of queries hold, and their results on odd rows."""

import random

from folio.operators import layout, progress
from folio.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_requests_are_counted_in_stretches(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b"]), rnd.randrange(-150_000, 150_000)) for i in range(300)] + [(300, "a", None), (301, "a", None), (302, None, 5), (303, "a", 0), (304, "a", 60_000), (305, "a", 59_999)]
    events = spark.createDataFrame(rows, "event_id long, k string, ms long")
    got = progress.recent_requests(events, "k")
    near = lambda t, u: t is None and u is None or t is not None and u is not None and t - 59_999 <= u <= t
    want = {i: sum(k == k2 and near(t, u) for _, k2, u in rows) for i, k, t in rows}
    assert {r.event_id: r.in_window for r in got.collect()} == want and got.columns == [*events.columns, "in_window"]
    # no frame is gone through again for each row, and a key is not one task
    assert "59999" not in plan(got) and "hashpartitioning(_key" in plan(got) and "hashpartitioning(k" not in plan(got)


def test_segments_of_a_line_need_no_sort(spark):
    assert "Window" not in plan(QUERIES["line_segments"](spark, SF))
    rows = [(1, 0.0, 1, "a", 10.0, 10.0), (1, 40.0, 0, "c", 50.0, 10.0), (1, 12.0, 2, "b", 20.0, None), (2, None, 0, "x", None, 10.0), (2, 3.0, 1, "y", 9.0, 10.0)]
    items = spark.createDataFrame(rows, "k int, x double, seq int, text string, right double, font double")
    assert sorted(tuple(r) for r in layout.segments(items, ["k"]).collect()) == [(1, 0, 0.0, "a b"), (1, 1, 40.0, "c"), (2, 0, None, "x y")]


def test_rows_of_a_docx_file_are_shuffled_once_after_reading(spark):
    for name in ("docx_tables", "docx_counters", "docx_blocks"):
        after_reading = plan(QUERIES[name](spark, SF)).split("MapInArrow")[0]
        assert after_reading.count("Exchange") == 1, name


def test_a_paragraph_is_gone_through_once(monkeypatch):
    from xml.etree import ElementTree

    from folio.sources import ooxml

    passes = []
    node = ElementTree.fromstring("<p><pPr><pStyle val='Title'/><sz val='18'/></pPr><r><rPr><sz val='20'/></rPr><t>x</t><tab/></r><p><t>y</t></p></p>")
    parsed = ElementTree.tostring(node)
    monkeypatch.setattr(ooxml, "_all", lambda n, name: passes.append(name) or [])
    got = ooxml._paragraph(ElementTree.fromstring(parsed), {})
    assert not passes and (got["text"], got["style"], got["max_font_size"], got["list"]) == ("x\ty", "Title", 20.0, False)
    assert ooxml._paragraph(ElementTree.fromstring("<p/>"), {}).keys() == got.keys()


def test_requests_of_a_provider_are_held_as_arrow(monkeypatch):
    """Answers go out in parts, in order over all frames, and the state is kept once; no frames are put together by pandas."""
    import pandas as pd

    from folio.streaming import limits

    class State:
        exists, kept = False, None

        def update(self, value):
            self.kept = value

    monkeypatch.setattr(limits, "CHUNK", 7)
    monkeypatch.setattr(pd, "concat", lambda *_: 1 / 0)
    rows = [("p", None if i % 9 == 8 else f"r{i % 2}", f"u{i:02}", 100 * (i * 7 % 5), 3) for i in range(20)]
    frames = [pd.DataFrame(rows[i : i + 6], columns=["provider", "run_id", "unit", "ms", "rpm"]) for i in range(0, 20, 6)]
    state = State()
    got = [tuple(r) for f in limits._grant(("p",), iter(frames), state) for r in f.itertuples(index=False)]
    want = sorted(rows, key=lambda r: (r[3], r[1] is None, r[1] or "", r[2]))
    assert [r[1:4] for r in got] == [r[1:4] for r in want] and state.kept == ([r[4] for r in got],)


def test_plain_texts_are_left_as_they_are(spark):
    from pyspark.sql import functions as F

    from folio.functions import text

    rows = [("a b, é中.", "a b, é中."), (" a", "a"), ("a  b", "a b"), ("co- op", "coop"), ("A- op", "A- op"), ("( a )", "(a)"), ("a ,", "a,"), ("a b", "a b"), ("ﬁn", "fin"), ("x­y", "xy"), ("a\n", "a"), ("", "")]
    got = spark.createDataFrame(rows, "t string, want string").select("want", text.normalize_extracted(F.col("t")).alias("got"), text._plain(F.col("t"), r"|- | [,.;:!?%)]|\( ").alias("plain")).collect()
    assert [r.got for r in got] == [r.want for r in got] and [r.plain for r in got] == [True] + [False] * 10 + [True]
