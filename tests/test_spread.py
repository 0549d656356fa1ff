"""Queries whose rows cost much each: every shuffle partition is a task of its own, and files are read with less work."""

import io
import re
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import blocks, layout
from folio.queries import QUERIES
from folio.sources import docx_export, ooxml
from jobs import worklist

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["docx_tables", "table_detect", "weighting_table", "xlsx_text"])
def test_partitions_of_costly_rows_are_not_put_together(spark, name):
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


def test_tokens_are_joined_without_patterns(spark):
    marks = [*text.CLOSING, *text.CLOSING_BRACKETS, *text.OPENING, "-", "/", "\u33ff", "\u3400", "\u9fff", "\ua000", "\U00020000", "a", "^", "\\"]
    df = spark.createDataFrame([(a, b) for a in marks for b in marks], "a string, b string")
    one = lambda c, chars: f"[{''.join(map(re.escape, chars))}\u3400-\u9fff]"
    tight = lambda a, b: re.match(one(b, text.CLOSING + text.CLOSING_BRACKETS), b) or re.match(one(a, text.OPENING), a)
    lines = lambda a, b: re.match(one(a, "-/"), a) or re.match("[\u3400-\u9fff]", b)
    got = df.select("a", "b", text.join_tokens(F.array("a", "b")).alias("t"), text.join_lines(F.array("a", "b")).alias("l"))
    for r in got.collect():
        assert r.t == (r.a + r.b if tight(r.a, r.b) else f"{r.a} {r.b}") and r.l == (r.a + r.b if lines(r.a, r.b) else f"{r.a} {r.b}"), r
    assert "RLIKE" not in plan(df.select(text.join_squeezed(F.array("a", "b"))))


def test_two_anchors_or_the_only_one_are_near():
    assert layout._covered([0.0, 50.0], [1.0, 49.0], 2.0) and not layout._covered([0.0, 50.0], [1.0, 45.0], 2.0) and layout._covered([7.0], [5.0], 2.0) and not layout._covered([], [5.0], 2.0)
    assert not layout._covered([1.0, 1.5], [1.0, 45.0], 2.0) and layout._covered([1.0], [0.0, 2.0], 2.0)


@pytest.mark.parametrize("inner", ["<r><t>a</t></r><r><t/><t>b</t></r>", "<r><t>a<x>b</x>c</t></r>", "<pPr><tabs><tab/></tabs></pPr><r><t>a</t><tab/><t>b</t><br><t>c</t></br></r>", "<r>out<t>a</t>out</r>", "<pPr/>"])
def test_text_of_a_paragraph_whose_elements_are_known(inner):
    node = ElementTree.fromstring(f"<p>{inner}</p>")
    assert ooxml._text(node, ooxml._by_name(node)) == ooxml._content(node) == ooxml._paragraph(node, {})["text"]


def test_relations_that_files_share_are_parsed_once(monkeypatch):
    made = docx_export._zipped(f'<w:document xmlns:w="{docx_export.WORD}"><w:body><w:p/></w:body></w:document>', ["image1.png"], [b"x"])
    ooxml._relations.cache_clear()
    passes, real = [], ElementTree.fromstring
    monkeypatch.setattr(ooxml.ElementTree, "fromstring", lambda data: passes.append(1) or real(data))
    both = [ooxml.docx_rows(made) for _ in range(2)]
    assert len(passes) == 3 and both[0] == both[1] and ooxml.assets(ooxml.Package(made))[0][0]["data"] == b"x"
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("word/_rels/document.xml.rels", "<!DOCTYPE x>")
    for _ in range(2):  # what is refused stays refused
        with pytest.raises(ValueError, match="refused"):
            ooxml.assets(ooxml.Package(bad.getvalue()))


def test_lines_of_a_work_list_are_cleaned_once(spark):
    docs = spark.createDataFrame([(1, "co- operate , so ( it ) is\n12\narXiv:1 2101.00001\nfine text", "en")], "doc_id long, text string, lang string")
    units = worklist.units(docs, 2800)
    assert sorted((r.ord, r.text) for r in units.collect()) == [(1, "cooperate, so (it) is"), (4, "fine text")]
    assert units._jdf.queryExecution().optimizedPlan().toString().count("{2,})-[") == 1  # the pattern for broken words


def test_running_heads_are_looked_for_at_the_start(spark):
    rows = [("ARXIV: x 2101.00001v1", True), ("x arXiv: 2101.00001", False), ("[q-fin.PM] 3 Jan 2021", True), (" [q-fin.PM] 3 Jan 2021", False), ("J. Risk Financial Manag. 2021 https://x", True), ("123", True), ("1234", False), ("a\n123", False), ("", False), (None, False)]
    df = spark.createDataFrame(rows, "t string, want boolean")
    assert all(r.got == r.want for r in df.select("want", blocks.furniture(F.col("t")).alias("got")).collect())
