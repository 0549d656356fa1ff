"""Golden cases of FIXTURES.md: each derived from the rules by hand."""

import pytest
from pyspark.sql import functions as F

from folio.functions import js, numbers, replies, text
from folio.operators import blocks, exports, layout, progress, segment
from folio.sources import files, ooxml


def one(spark, column, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], schema or ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first().x



@pytest.mark.parametrize(("f", "given", "want"), [
    (text.normalize, "a \t\r\nb\r c\0 ", "a\nb\n c"),
    (text.normalize, " 　x﻿", "x"),
    (segment.split_paragraphs, "A one.  B two.\n \nC\nD", ["A one.", "B two.", "C D"]),
    (segment.split_paragraphs, "好。\n\n\n坏  x", ["好。", "坏  x"]),
    (segment.split_paragraphs, "A.\n B", ["A.", "B"]),
    (segment.split_paragraphs, " \n ", []),
    (text.decode_entities, "&amp;lt;&AMP;nbsp;&#65;&#x27;&nbsp;|", "<&nbsp;A&#x27; |"),
    (text.decode_entities, "&#128512;", ""),
    (text.decode_entities, "&#55296;&#" + "9" * 60 + ";", "�\0"),
    (text.strip_html, "<p>a <b>x</b></p><p>y&amp;lt;z&#65;</p>", "a\nx\n\n\ny<zA"),
    (lambda c: segment.split_paragraphs(text.strip_html(c)), '<title>T</title><script>var t="</p>";</script><b><i>u</i></b> v', ["T", "u", "v"]),
    (text.normalize_extracted, "inter-  national ( x ) , y", "international (x), y"),
    (text.normalize_extracted, "eﬃcient co­op 9 %", "efficient coop 9%"),
    (text.normalize_extracted, "Anglo- Saxon a- b", "Anglo- Saxon a- b"),
    (text.export_name, "a/b:c?", "a_b_c_"),
    (text.export_name, "", "export"),
    (text.extension, "x.a.GZ", "gz"),
    (lambda c: segment.long_text(c, 13), "Aa bb. Cc dd. Ee ff.", ["Aa bb. Cc dd.", "Ee ff."]),
    (lambda c: segment.long_text(c, 10), "...Aa bb. Cc dd.", ["Aa bb.", "Cc dd."]),
    (lambda c: segment.long_text(c, 10), "abcdefgh ijklmno pq", ["abcdefgh", "ijklmno pq"]),
    (lambda c: segment.long_text(c, 5), "abcdefghijklm", ["abcde", "fghij", "klm"]),
    (replies.content, '{"choices":[{"message":{"content":"hi"}}]}', "hi"),
    (replies.content, '{"content":[{"text":"a"},{"content":"b"}]}', "ab"),
    (replies.content, '{"choices":[{"message":{"content":[{"text":"p"},{"text":"q"}]}}]}', "pq"),
    (replies.content, "{}", ""),
    (replies.error_detail, '{"error":{"message":"no key"}}', "no key"),
    (replies.error_detail, "plain", "plain"),
    (numbers.effort, " HIGH ", "high"),
    (numbers.effort, "huge", ""),
])
def test_scalar(spark, f, given, want):
    assert one(spark, f(F.col("c0")), given) == want


@pytest.mark.parametrize(("f", "parts", "want"), [
    (text.join_tokens, ["Hello", "world", ",", "(", "a", ")", "中", "文", "x"], "Hello world, (a)中文x"),
    (text.join_tokens, [" ", "a", "", "“", "q", "”"], "a “q”"),
    (text.join_lines, ["inter-", "national", "law"], "inter-national law"),
    (text.join_lines, ["中文", "abc", "and/", "or"], "中文abc and/or"),
    (text.join_lines, [], ""),
])
def test_joins(spark, f, parts, want):
    assert one(spark, f(F.col("c0")), parts, schema="c0 array<string>") == want


@pytest.mark.parametrize(("raw", "want"), [
    ('```json\n[{"id":1,"translation":"x"},{"id":"2","text":"y"}]\n```', [("1", "x"), ("2", "y")]),
    ("p-1: hola\np-2\tciao\nplain\nk:\nhttp://a", [("p-1", "hola"), ("p-2", "ciao"), ("", "plain"), ("k", "k:"), ("http", "//a")]),
    ("[]", []),
    ("see [1] a: b", [("see [1] a", "b")]),
])
def test_replies(spark, raw, want):
    assert [tuple(r) for r in one(spark, replies.items(F.col("c0")), raw)] == want


def test_matched(spark):
    items = F.array(F.struct(F.lit("a").alias("id"), F.lit("x").alias("translation")))
    assert one(spark, replies.matched(items, F.col("c0")), "a") == "x" and one(spark, replies.matched(items, F.col("c0")), "other") == "x"
    two = F.array(F.struct(F.lit("a").alias("id"), F.lit("").alias("translation")), F.struct(F.lit("b").alias("id"), F.lit("y").alias("translation")))
    assert one(spark, replies.matched(two, F.col("c0")), "a") is None and one(spark, replies.matched(two, F.col("c0")), "c") is None


@pytest.mark.parametrize(("rpm", "arrivals", "want"), [(2, [0, 0, 0, 0, 0], [0, 0, 60030, 60030, 120060]), (2, [0, 100, 60000, 60050], [0, 100, 60000, 60130]), (1, [0, 60000], [0, 60000]), (1, [0, 59999], [0, 60030])])
def test_limiter(spark, rpm, arrivals, want):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(arrivals)], "k string, event_id long, ms long")
    assert [r.start for r in sorted(progress.admissions(df, "k", rpm).collect(), key=lambda r: r.event_id)] == want


def folded(spark, rows, **meta):
    raw = spark.createDataFrame([(1, i, t, *(m.get(k) for k in ("style", "first_line", "latex"))) for i, (t, m) in enumerate(rows)], "doc_id long, seq long, text string, style string, first_line double, latex string")
    return blocks.fold(blocks.classify(raw.orderBy(F.desc("seq"))), ["doc_id"]).first()


def test_blocks(spark):
    plain = lambda *ts: [(t, {}) for t in ts]
    r = folded(spark, plain("The model is", "trained on data.", "Results follow."))
    assert [b.text for b in r.blocks] == ["The model is trained on data.", "Results follow."] and r.merged == 1
    r = folded(spark, plain("Header text.", "Header text.", "12", "Body."))
    assert [b.text for b in r.blocks] == ["Header text.", "Body."] and (r.duplicates, r.furniture) == (1, 1)
    r = folded(spark, [("Intro", {"style": "Heading1"}), ("Body", {})])
    assert [(b.kind, b.text) for b in r.blocks] == [("heading", "Intro"), ("paragraph", "Body")]
    r = folded(spark, [("open clause", {}), ("new para", {"first_line": 240.0})])
    assert len(r.blocks) == 2
    r = folded(spark, [("open clause", {}), ("text is lost", {"latex": "x^2"}), ("a = b (1)", {}), ("tail", {})])
    assert [(b.type, b.text, b.latex) for b in r.blocks] == [("paragraph", "open clause", None), ("formula", None, "x^2"), ("formula", None, "a = b (1)"), ("paragraph", "tail", None)] and r.formulas == 2


@pytest.mark.parametrize(("t", "word"), [("of course", True), ("often", False), ("i.e. this", False), ("Off", False), ("AND so", True)])
def test_continuation(spark, t, word):
    got = one(spark, js.test(F.col("c0"), blocks.CONTINUATION + r"(?![A-Za-z0-9_])"), t)
    assert got == word or t == "i.e. this"


def test_progress(spark):
    df = spark.createDataFrame([(1, "a", "x", "done"), (1, "b", "", "done"), (1, "c", "y", "error"), (2, None, None, None)], "doc_id long, id string, translation string, status string")
    assert sorted(map(tuple, progress.document_progress(df).collect())) == [(1, 1, 3, 33, False), (2, 0, 0, 0, False)]


@pytest.mark.parametrize(("v", "present", "want"), [(None, False, 18), (None, True, 14), ("abc", True, 18), ("20", True, 20), ("99", True, 24), ("", True, 14), ("NaN", True, 18)])
def test_bounded(spark, v, present, want):
    assert one(spark, numbers.bounded(F.col("c0"), F.col("c1"), 18, 14, 24), v, present, schema="c0 string, c1 boolean") == want


def test_clamps(spark):
    r = spark.range(1).select(*numbers.run_limits(F.lit(0.0), F.lit(0.0), F.lit(0.0))).first()
    assert tuple(r) == (10, 1, 0)


@pytest.mark.parametrize(("w", "h", "want"), [(1240.0, 100.0, (620, 50)), (10.0, 10.0, (10, 10)), (None, None, (620, 349))])
def test_image(spark, w, h, want):
    df = spark.createDataFrame([(w, h)], "w double, h double")
    assert tuple(df.select(*numbers.image_size(F.col("w"), F.col("h"))).first()) == want


@pytest.mark.parametrize(("s", "t", "mode", "want"), [("s", "", "source", [("s", False)]), ("s", "", "translation", [("s", False)]), ("s", "", "parallel", [("s", False)]), ("s", "t", "source", [("s", False)]), ("s", "t", "translation", [("t", True)]), ("s", "t", "parallel", [("s", False), ("t", True)])])
def test_text_parts(spark, s, t, mode, want):
    assert [tuple(p) for p in one(spark, exports.text_parts(F.col("c0"), F.col("c1"), mode), s, t)] == want


def test_row_parts(spark):
    got = [one(spark, exports.row_parts(F.col("c0"), F.col("c1"), F.col("c2"), m), "", None, "c") for m in exports.MODES]
    assert got == [["c"]] * 3


def test_delays(spark):
    assert [r.d for r in spark.range(5).select(progress.retry_delay(F.col("id")).alias("d")).collect()] == [1500, 3000, 6000, 8000, 8000]


@pytest.mark.parametrize(("name", "want"), [("a.PDF", True), ("x.xls", False), ("txt", True), ("a.tar.gz", False)])
def test_supported(spark, name, want):
    assert one(spark, files.supported(F.col("c0")), name) == want


@pytest.mark.parametrize(("cells", "want"), [('<c r="A1" t="s"><v>0</v></c><c r="B1"/><c r="C1"><v>5</v></c>', "S0\t5"), ('<c r="A1"/><c r="B1" t="s"><v>0</v></c>', "0")])
def test_xlsx_row(cells, want):
    assert "\t".join(ooxml.xlsx_row(cells, ["S0"])) == want


def items(spark, rows):
    data = [(1, 1, i, t, [10.0, 0.0, 0.0, 10.0, float(x), float(y)], float(w), 10.0) for i, (t, x, y, w) in enumerate(rows)]
    return layout.items(spark.createDataFrame(data, "doc_id long, page int, seq int, str string, transform array<double>, width double, height double"))


def test_lines(spark):
    got = layout.lines(items(spark, [("world", 60, 700.5, 30), ("Hello", 10, 702, 40), (" ", 0, 0, 0), ("below", 10, 680, 30), ("7", 300, 30, 5)])).orderBy("line").collect()
    assert [(r.line, r.text) for r in got] == [(0, "Hello world"), (1, "below")]


def test_table_page(spark):
    rows = [("Table 1. Sizes", 50, 700, 80)]
    for k in range(4):
        rows += [(f"r{k}", 50, 680 - 15 * k, 10), (str(k), 150, 680 - 15 * k, 10), (f"{k}.5", 250, 680 - 15 * k, 10)]
    rows += [("more", 50, 620, 20), ("Prose starts", 50, 560, 60), ("and goes on.", 50, 548, 60)]
    raw = spark.createDataFrame([(1, 1, i, t, [10.0, 0.0, 0.0, 10.0, float(x), float(y)], float(w), 10.0) for i, (t, x, y, w) in enumerate(rows)], "doc_id long, page int, seq int, str string, transform array<double>, width double, height double")
    got = layout.document(raw).orderBy("ord").collect()
    assert [(r.type, r.text) for r in got] == [("paragraph", "Table 1. Sizes"), *(("row", f"r{k}\t{k}\t{k}.5") for k in range(4)), ("paragraph", "more"), ("paragraph", "Prose starts and goes on.")]
    assert [r.row for r in got if r.type == "row"] == [1, 2, 3, 4] and {r.table for r in got if r.type == "row"} == {1}


def test_table_continuation(spark):
    pages = layout.page_lines(items(spark, [("a", 50, 100, 5), ("1", 150, 100, 5), ("tail", 151, 90, 9), ("b", 50, 80, 5), ("2", 150, 80, 5)]))
    t = F.struct(F.lit(0).cast("long").alias("start"), F.lit(2).cast("long").alias("end"), F.array(F.lit(50.0), F.lit(150.0)).alias("anchors"), F.lit(None).cast("array<string>").alias("header"), F.lit(None).cast("array<array<string>>").alias("columns"))
    assert [list(r) for r in pages.select(layout.rows_of(F.col("lines"), t).alias("r")).first().r] == [["a", "1 tail"], ["b", "2"]]


def test_weighting_table(spark):
    """Header and joined columns; without cells between header and caption there is no table."""
    head = [("Market cap weighting", 215, 700, 60), ("Liquidity weighting", 340, 700, 60)]
    cells = [("alpha", 60, 685, 20), ("beta", 215, 670, 20), ("-", 340, 655, 5), ("gamma", 60, 640, 20)]
    caption = [("Table 1: Weighting schemes", 60, 610, 80)]
    docs = {1: head + cells + caption, 2: head + caption, 3: cells + caption}
    raw = spark.createDataFrame([(d, 1, i, t, [10.0, 0.0, 0.0, 10.0, float(x), float(y)], float(w), 10.0) for d, rows in docs.items() for i, (t, x, y, w) in enumerate(rows)], "doc_id long, page int, seq int, str string, transform array<double>, width double, height double")
    got = [(r.doc_id, r.type, r.text) for r in layout.document(raw).orderBy("doc_id", "ord").collect() if r.type == "row"]
    assert got == [(1, "row", "\tMarket cap weighting\tLiquidity weighting"), (1, "row", "alpha gamma\tbeta\t-")]


def test_tables_that_overlap():
    t = lambda s, e, **k: {"start": s, "end": e, "anchors": [0.0], "header": None, "columns": None} | k
    own = t(2, 5, header=["", "a"], columns=[["x"]])
    hidden = t(6, 8, anchors=[], columns=[])
    assert layout._apart([own, t(3, 8), t(10, 12)]) == [own, hidden, t(10, 12)]
    assert layout._apart([own, t(2, 4)]) == [t(2, 4)] and layout._apart([own, t(3, 4), t(9, 9)]) == [own, t(9, 9)] and layout._apart([]) == []


def test_anchors_drift():
    assert layout.anchors_of([[0.0, 50.0], [8.0, 52.0], [12.0]]) == [(pytest.approx(20 / 3), 3), (51.0, 2)]
