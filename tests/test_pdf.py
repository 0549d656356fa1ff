"""PDF files written and read: the layout, the bytes, and files that are built otherwise or damaged."""

import re
import zlib

import pytest

from folio.functions import fonts
from folio.plans import documents
from folio.sources import files, pdf, pdf_export

ROW = "d string, ord int, title string, kind string, source string, translation string, table int, row int, col int, columns int"


def stream(data, extra="", packed=True):
    body = zlib.compress(data) if packed else data
    return f"<< /Length {len(body)} {'/Filter /FlateDecode' if packed else ''} {extra} >>\nstream\n".encode("latin-1") + body + b"\nendstream"


def built(objs, tail=b""):
    """A file of objects (number, bytes)."""
    return b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % o for o in objs) + tail + b"trailer << /Root 1 0 R >>\n%%EOF"


CMAP = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0011> <D83DDE00> endbfchar 2 beginbfrange <0024> <0026> <0041> <0030> <0031> [<4E2D> <6587>] endbfrange"
HEAD = [(1, b"<< /Type /Catalog /Pages 2 0 R >>")]
TREE = [(2, b"<< /Type /Pages /Kids [8 0 R 3 0 R] /Count 3 /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >>"), (8, b"<< /Type /Pages /Parent 2 0 R /Kids [9 0 R 10 0 R] /Count 2 >>")]
FONTS = [
    (5, b"<< /Type /Font /Subtype /TrueType /Encoding /WinAnsiEncoding /FirstChar 65 /Widths [500 1000] >>"),
    (6, b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /ToUnicode 7 0 R /DescendantFonts [11 0 R] >>"),
    (7, stream(CMAP)),
    (11, b"<< /Type /Font /Subtype /CIDFontType2 /DW 900 /W [36 [600 700] 48 49 1000] >>"),
]
PAGES = [
    (3, b"<< /Type /Page /Parent 2 0 R /Contents [12 0 R 13 0 R] >>"),
    (9, b"<< /Type /Page /Parent 8 0 R /Contents 14 0 R >>"),
    (10, b"<< /Type /Page /Parent 8 0 R /Contents 15 0 R >>"),
    (12, stream(b"q 2 0 0 2 10 20 cm BT /F1 10 Tf 5 6 Td (A\\102\\)\\\\) Tj")),
    (13, stream(b" 0 -12 TD [(A) -300 (B) 20 (A)] TJ T* (x) ' ET Q BT /F1 8 Tf 1 0 0 1 50 60 Tm (done) Tj ET", packed=False)),
    (14, stream(b"BT /F2 10 Tf 0 1 -1 0 100 200 Tm <002400250003003000310011> Tj ET")),
    (15, b"[ 16 0 R ]"),
    (16, stream(b"BI /W 1 ID (no) Tj EI BT /F9 12 Tf 2 Tc 3 Tw 10 10 Td (a b) Tj ET")),
]
WHOLE = HEAD + TREE + FONTS + PAGES


def read(spark, **content):
    f = spark.createDataFrame([(k, v) for k, v in content.items()], "path string, content binary").repartition(2)
    found = pdf.items(f)
    rows = sorted(((r.doc_id, r.page, r.seq, r.str, [round(x, 3) for x in r.transform], round(r.width, 3), round(r.height, 3)) for r in found.collect()), key=lambda r: r[:3])
    return rows, {r.path: r.error for r in pdf.failures(f, found).collect()}


def test_operators_and_fonts(spark):
    rows, failed = read(spark, f=built(WHOLE))
    assert not failed and [r[1:4] for r in rows] == [(1, 0, "AB 中文😀"), (2, 0, "a b"), (3, 0, "AB)\\"), (3, 1, "A BA"), (3, 2, "x"), (3, 3, "done")]
    by = {r[3]: r[4:] for r in rows}
    assert by["AB 中文😀"] == ([0.0, 10.0, -10.0, 0.0, 100.0, 200.0], round((0.6 + 0.7 + 0.9 + 1 + 1 + 0.9) * 10, 3), 10.0)
    assert by["AB)\\"] == ([20.0, 0.0, 0.0, 20.0, 20.0, 32.0], 30.0, 20.0)
    assert by["A BA"][0][4:] == [20.0, 8.0] and by["A BA"][1] == round(2 * 10 * (0.5 + 0.3 + 1 - 0.02 + 0.5), 3)
    assert by["x"][0][4:] == [20.0, -40.0] and by["done"][0] == [8.0, 0.0, 0.0, 8.0, 50.0, 60.0]
    assert by["a b"][1] == round((556 + 278 + 556) / 1000 * 12 + 3 * 2 + 3, 3)


def test_files_of_other_kinds(spark):
    """Objects in streams, changes at the end, no page tree, no pages, garbage, encryption."""
    inner = [(n, d) for n, d in HEAD + TREE + FONTS if b"stream" not in d]
    heads, at = [], 0
    for n, d in inner:
        heads.append(f"{n} {at}")
        at += len(d) + 1
    first = " ".join(heads).encode() + b" "
    packed = [(30, stream(first + b"\n".join(d for _, d in inner), f"/Type /ObjStm /N {len(inner)} /First {len(first)}")), (7, stream(CMAP)), *PAGES]
    changed = built(WHOLE) + b"\n13 0 obj\n" + stream(b"ET Q BT /F1 8 Tf 1 0 0 1 50 60 Tm (new) Tj ET") + b"\nendobj\n"
    loose = built([o for o in WHOLE if o[0] not in (1, 2, 8)])
    bare = built([(1, stream(b"BT /F1 9 Tf 1 2 Td (only) Tj ET"))])
    rows, failed = read(spark, whole=built(WHOLE), packed=built(packed), changed=changed, loose=loose, bare=bare, junk=b"%PDF none", locked=built(WHOLE, b"trailer << /Encrypt 9 0 R >>\n"), empty=b"", none=None, cut=built(WHOLE)[:300])
    of = lambda k: [r[1:] for r in rows if r[0] == k]
    assert of("packed") == of("whole") and len(of("whole")) == 6
    assert [r[2] for r in of("changed")] == ["AB 中文😀", "a b", "AB)\\", "new"]
    loose = [r[2] for r in of("loose")]  # in the order of the file, and without the fonts of the tree
    assert loose[:4] == ["AB)\\", "A BA", "x", "done"] and loose[-1] == "a b" and {r[0] for r in of("loose")} == {1, 2, 3}
    assert [r[:3] for r in of("bare")] == [(1, 0, "only")]
    assert failed == {"junk": pdf.NO_TEXT, "empty": pdf.NO_TEXT, "none": pdf.NO_TEXT, "cut": pdf.NO_TEXT, "locked": pdf.ENCRYPTED}


def test_streams():
    assert pdf.unpacked(b"68 65 6c6C 6f>", ["ASCIIHexDecode"]) == b"hello" and pdf.unpacked(b"<~87cURDZ~>", ["A85"]) == b"Hello"
    assert pdf.unpacked(zlib.compress(b"x" * 99)[:-3], ["FlateDecode"]).startswith(b"x") and pdf.unpacked(b"?", ["FlateDecode"]) == b"" == pdf.unpacked(b"?", ["LZWDecode"])


def export_rows():
    long = " ".join(f"word{i}" for i in range(1500))
    out = [("a", 1, "Title of a", "heading", "First (part)", None), ("a", 2, "Title of a", "paragraph", long, "译文 " * 200), ("a", 3, "Title of a", "caption", "Fig. 1", ""), ("a", 9, "Title of a", "paragraph", "After\nthe table \\ end", None)]
    out += [("b", 1, None, None, None, None), ("b", 2, None, "paragraph", "x" * 300, None), ("c", 1, "", "paragraph", "", None)]
    rows = [(*r, None, None, None, None) for r in out]
    rows += [("a", 4, "Title of a", "table-cell", t, None, 1, i // 2 + 1, i % 2 + 1, 2) for i, t in enumerate(["h1", "h2", "1", "tall " * 400, "", "2"])]
    return rows


def test_layout(spark):
    rows = export_rows()
    got = pdf_export.layout(spark.createDataFrame(rows, ROW).repartition(3), "d", "ord").orderBy("d", "seq").collect()
    assert {r.d for r in got} == {"a", "b"}
    for r in got:
        assert pdf_export.TOP <= r.y and r.y + r.height <= pdf_export.FLOOR + 0.01 and r.x + r.width <= pdf_export.PAGE_WIDTH - pdf_export.RIGHT + 0.01
    a = [r for r in got if r.d == "a"]
    words = " ".join(r.text for r in a if r.op == "text" and r.latin).split()
    assert words == ["Title", "of", "a", "First", "(part)", *(f"word{i}" for i in range(1500)), "Fig.", "1", "h1", "h2", "1", *["tall"] * 400, "2", "After", "the", "table", "\\", "end"]
    assert "".join(r.text for r in a if r.op == "text" and not r.latin).replace(" ", "") == "译文" * 200
    body = [r for r in a if r.text.startswith("word")]
    assert all((r.page, r.y) < (s.page, s.y) for r, s in zip(body, body[1:], strict=False)) and len({r.page for r in body}) > 1
    assert all(abs(r.width + r.spacing * r.text.count(" ") - pdf_export.CONTENT) < 0.01 for r in body[:-1])
    assert [r.op for r in a if r.op != "text"] == ["fill", "box"] * 2 + ["box"] * 4
    cut = [r.text for r in got if r.d == "b"]
    assert "".join(cut) == "x" * 300 and len(cut) == 4


@pytest.mark.parametrize("text", ["one two  three", "a" * 50, "", "中文字符" * 9, "é " * 30, "mixed 中 text"])
def test_lines_fit(text):
    lines = pdf_export.wrap(text, 60, 10)
    latin = fonts.is_latin(text)
    assert all(sum(fonts.advances(t, latin)) == n <= 6000 for t, n in lines)
    assert "".join(t for t, _ in lines).replace(" ", "") == text.replace(" ", "")
    for (a, n), (b, _) in zip(lines, lines[1:], strict=False):  # nothing more would have fitted
        space = 278 if latin else 500
        free = not latin and b[:1] > "⺀" or " " not in text  # may be cut anywhere
        more = b[:1] if free else b.split(" ")[0]
        assert n + (0 if free else space) + sum(fonts.advances(more, latin)) > 6000, (a, b)


def test_bytes(spark):
    """By a reader of the table of references alone: every object where it says, lengths right, pages as laid out."""
    df = spark.createDataFrame(export_rows(), ROW)
    out = {r.d: bytes(r.content) for r in pdf_export.pdf(df, "d", "ord").collect()}
    assert set(out) == {"a", "b"}
    laid = pdf_export.layout(df, "d", "ord").collect()
    for d, raw in out.items():
        at = int(re.search(rb"startxref\n(\d+)\n%%EOF\n$", raw)[1])
        table = raw[at:].split(b"trailer")[0].split(b"\n")
        n = int(table[1].split()[1])
        assert table[0] == b"xref" and table[2] == b"0000000000 65535 f " and all(len(x) == 19 for x in table[2 : 2 + n])
        objs = {}
        for i in range(1, n):
            start = int(table[2 + i][:10])
            assert raw[start:].startswith(b"%d 0 obj\n" % i)
            objs[i] = raw[start : raw.index(b"\nendobj", start)].split(b"obj\n", 1)[1]
        kids = [int(x) for x in re.findall(rb"(\d+) 0 R", re.search(rb"/Kids \[(.*?)\]", objs[2])[1])]
        assert len(kids) == max(r.page for r in laid if r.d == d)
        for p, k in enumerate(kids, 1):
            body = objs[int(re.search(rb"/Contents (\d+)", objs[k])[1])]
            head, ops = body.split(b"\nstream\n")
            ops = ops.removesuffix(b"\nendstream")
            assert int(re.search(rb"/Length (\d+)", head)[1]) == len(ops)
            assert ops.count(b" Tj") == sum(r.page == p and r.op == "text" and r.d == d for r in laid) + 1
    assert out["a"].decode("ascii") and re.search(rb"/Title <FEFF([0-9A-F]+)>", out["a"])[1].decode() == "Title of a".encode("utf-16-be").hex().upper()


def test_extraction(spark, tmp_path):
    """Written files found in a folder: text, paragraphs, and a row that says why there are none."""
    rows = [("a", i, "Report", "paragraph", t, None, None, None, None, None) for i, t in enumerate(["The first paragraph.", "The second one."])]
    f = pdf_export.pdf(spark.createDataFrame(rows, ROW), "d", "ord").first()
    for name, data in {"a.pdf": bytes(f.content), "b.pdf": b"%PDF", "c.txt": b"plain"}.items():
        (tmp_path / name).write_bytes(data)
    found = files.read_files(spark, str(tmp_path))
    texts = {r.name: (r.text, r.error) for r in files.extract_text(found).collect()}
    assert texts["c.txt"] == ("plain", None) and texts["b.pdf"] == (None, pdf.NO_TEXT)
    assert texts["a.pdf"] == ("Report\n\nThe first paragraph.\n\nThe second one.", None)  # the number of the page is no text
    got = sorted((r.path.rpartition("/")[2], r.para_id or "", r.text or "", r.error or "") for r in documents.extract(found).collect())
    assert ("b.pdf", "", "", pdf.NO_TEXT) in got and ("a.pdf", "p-1", "Report", "") in got and ("c.txt", "p-1", "plain", "") in got


def test_layout_of_some_operators(spark):
    """Boxes alone stand where they stand among all, rows that are higher than a page included."""
    rows = [("a", i, None, "table-cell", "word " * n, None, 1, 1 + i // 2, i % 2, 2) for i, n in enumerate([1, 900, 3, 3, 40, 2] * 4)] + [("a", 99, None, "paragraph", "end", "fin", None, None, None, None)]
    df = spark.createDataFrame(rows, ROW)
    whole = sorted(map(tuple, pdf_export.layout(df, "d", "ord").where("op = 'box'").collect()))
    assert len(whole) == 24 and sorted(map(tuple, pdf_export.layout(df, "d", "ord", ops=frozenset({"box"})).collect())) == whole
    assert fonts.sums("a b", True) == [0, 556, 834, 1390] and fonts.sums("aĀ", False) == [0, 500, 1500]
