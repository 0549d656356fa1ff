"""PDF files from export rows: a flow layout with page breaks, and the files' bytes.

layout() scans the rows of each document in order, with page and height so far as its only state, so no document is held:
texts become lines, table rows are as high as their highest cell, and what doesn't fit goes to the next page. content(),
objects() and pdf() are joins, running sums and joined strings: each page's operators are one string, objects are
numbered per document, and the places of the cross-reference table are a running sum over the objects' lengths.

Two fonts are named and none embedded: Helvetica for texts of Latin-1, else a wide one whose character codes are UTF-16.
Pictures and formulas are left out; a formula's LaTeX may be given as a caption.

Defined cases: a null or empty text gives nothing; a null title is no title; line ends begin a new line, other control
characters are dropped; a word wider than its line is cut; a table row higher than a page goes on in the next.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fonts
from ..operators.exports import text_parts

# Fixed values of the page and its styles, in points.
PAGE_WIDTH, PAGE_HEIGHT = 595.28, 841.89
TOP, RIGHT, BOTTOM, LEFT = 56.0, 58.0, 58.0, 58.0
CONTENT = PAGE_WIDTH - LEFT - RIGHT
FLOOR = PAGE_HEIGHT - BOTTOM
KEEP = 14.0  # room wanted below a text
TABLE_AFTER, ROW_LEAST, CELL_PAD, CELL_ROOM = 16.0, 28.0, 6.0, 2.0
FOOTER, FOOTER_SIZE, FOOTER_COLOR = 37.0, 8.0, "8A94A6"
TITLE_DOWN = 1.25
HEADER_FILL, GRID = "EEF3FA", "C8D1DE"


class Style(NamedTuple):
    size: float
    gap: float  # between lines
    after: float
    color: str
    align: str


TITLE = Style(18.0, 5.0, 0.0, "172033", "center")
CELL = Style(8.3, 2.0, 0.0, "172033", "left")


def style(kind: str | None, translated: bool) -> Style:
    size, gap, align = {"heading": (13.5, 5.0, "left"), "caption": (9.5, 4.0, "center")}.get(kind or "", (10.5, 4.0, "justify"))
    return Style(size, gap, 11.0 if translated else 6.0, "526078" if translated else "667085" if kind == "caption" else "172033", align)


def wrap(text: str, width: float, size: float) -> list[tuple[str, int]]:
    """Lines of a text and their widths in thousandths of the size: cut at the last space that fits, else, and in the
    wide font, at any character."""
    out: list[tuple[str, int]] = []
    limit = int(width * 1000 / size + 1e-9)
    latin = fonts.is_latin(text.replace("\n", ""))
    for part in text.split("\n"):
        sums = fonts.sums(part, latin)
        at, n = 0, len(part)
        while True:
            fits = bisect_right(sums, sums[at] + limit) - 1
            if fits >= n:
                out.append((part[at:], sums[n] - sums[at]))
                break
            space = part.rfind(" ", at, fits + 1)
            free = not latin and max(part[fits - 1 : fits + 1]) > "⺀"
            end = max(fits, at + 1) if free or space <= at else space
            out.append((part[at:end], sums[end] - sums[at]))
            at = end + (end < n and part[end] == " ")
    return out


_of_cell = lru_cache(4096)(wrap)  # short cells are often the same

LAID = "page int, seq int, op string, x double, y double, width double, height double, size double, spacing double, color string, latin boolean, text string"

OPS = frozenset({"text", "fill", "box"})


class _Flow:
    """Where the next line of a document goes. Rows of the operators asked for come out as tuples of LAID."""

    def __init__(self, ops: frozenset[str] = OPS) -> None:
        self.page, self.y, self.seq, self.out, self.ops = 1, TOP, 0, [], ops

    def turn(self) -> None:
        self.page, self.y = self.page + 1, TOP

    def put(self, page: int, op: str, x: float, y: float, width: float, height: float, size: float = 0.0, spacing: float = 0.0, color: str = "", latin: bool = True, text: str = "") -> None:
        self.seq += 1
        if op in self.ops:
            self.out.append((page, self.seq, op, x, y, width, height, size, spacing, color, latin, text))

    def text(self, text: str, s: Style, keep: bool = True) -> None:
        lines = wrap(text, CONTENT, s.size)
        high, latin = s.size * fonts.LINE, fonts.is_latin(text.replace("\n", ""))
        if keep and self.y + len(lines) * (high + s.gap) + s.after + KEEP > FLOOR:
            self.turn()
        for i, (t, units) in enumerate(lines):
            if self.y + high > FLOOR:
                self.turn()
            wide = units * s.size / 1000
            x = LEFT + (CONTENT - wide) / 2 if s.align == "center" else LEFT
            spaces = t.count(" ")
            stretch = (CONTENT - wide) / spaces if s.align == "justify" and latin and spaces and i + 1 < len(lines) else 0.0
            if t:
                self.put(self.page, "text", x, self.y, wide, high, s.size, stretch, s.color, latin, t)
            self.y += high + s.gap
        self.y += s.after

    def row(self, cells: list[str], columns: int, header: bool) -> None:
        wide = CONTENT / max(1, columns)
        high = CELL.size * fonts.LINE
        lines = [(_of_cell if len(c) <= 16 else wrap)(c or " ", wide - 2 * CELL_PAD, CELL.size) for c in cells]
        tall = max(ROW_LEAST, *(len(x) * (high + CELL.gap) + 2 * CELL_PAD for x in lines))
        if self.y + tall + CELL_ROOM > FLOOR:
            self.turn()
        page, y, last = self.page, self.y, (self.page, self.y + tall)
        for k, own in enumerate(lines):
            x = LEFT + k * wide
            if header:
                self.put(page, "fill", x, y, wide, min(tall, FLOOR - y), color=HEADER_FILL)
            self.put(page, "box", x, y, wide, min(tall, FLOOR - y), color=GRID)
            if "text" not in self.ops and y + tall <= FLOOR:  # no line goes to the next page
                self.seq += sum(1 for t, _ in own if t.strip())
                continue
            p, at, latin = page, y + CELL_PAD, fonts.is_latin(cells[k].replace("\n", ""))
            for t, units in own:
                if at + high > FLOOR:
                    p, at = p + 1, TOP
                if t.strip():
                    self.put(p, "text", x + CELL_PAD, at, units * CELL.size / 1000, high, CELL.size, 0.0, CELL.color, latin, t)
                at += high + CELL.gap
            if p > page:
                last = max(last if last[0] > page else (p, TOP), (p, at + CELL_PAD))
        self.page, self.y = last


_CONTROLS = re.compile(r"[\x00-\x09\x0b-\x1f\x7f-\x9f]")


def _clean(t: str | None) -> str:
    return _CONTROLS.sub("", (t or "").replace("\t", " "))


def layout(rows: DataFrame, key: str, order: str, mode: str = "parallel", ops: frozenset[str] = OPS) -> DataFrame:
    """(key, page, seq, op text, fill or box, x, y from the top, width, height ...) of rows (key, order, title, kind,
    source, translation); cells of tables (kind table-cell) have table, row, col and columns as well.

    ops: the operators whose rows are wanted. All are laid out and numbered, but the others' rows are not made.
    """
    cell = [c for c in ("table", "row", "col", "columns") if c in rows.columns]
    more = [F.col(c).cast("long").alias(c) if c in cell else F.lit(None).cast("long").alias(c) for c in ("table", "row", "col", "columns")]
    parts = text_parts(F.col("source"), F.col("translation"), mode).alias("parts")
    r = rows.select(F.col(key).alias("_k"), F.col(order).alias("_o"), "title", F.coalesce("kind", F.lit("paragraph")).alias("kind"), parts, *more)
    n = max(12, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow, cells, of, last, began = _Flow(ops), [], None, None, False

        def end_row(next_table) -> None:
            nonlocal cells, of
            if cells:
                flow.row(cells, of[2] or len(cells), (of[1] or 1) == 1)
                cells = []
            if of is not None and next_table != of[0]:
                flow.y += TABLE_AFTER
                of = None

        for b in batches:
            done: list[tuple] = []
            parts = b.column("parts")
            flat = parts.flatten()
            texts, turned = (_values(flat.field(c)) for c in ("text", "translated"))
            at = 0
            columns = (_values(b.column(c)) for c in ("_k", "title", "kind", "table", "row", "columns"))
            for k, title, kind, table, row, wide, count in zip(*columns, _values(parts.value_lengths()), strict=True):
                own, at = range(at, at + count), at + count
                if not began or k != last:
                    end_row(None)
                    done += [(last, *x) for x in flow.out]
                    flow, last, began = _Flow(ops), k, True
                    if t := _clean(title):
                        flow.text(t, TITLE, keep=False)
                        flow.y += TITLE_DOWN * TITLE.size * fonts.LINE
                if kind == "table-cell":
                    if of is None or (table, row) != of[:2]:
                        end_row(table)
                        of = (table, row, wide)
                    cells.append(_clean(texts[own[0]] if count == 1 else "\n".join([texts[i] for i in own])))
                else:
                    end_row(None)
                    for i in own:
                        if t := _clean(texts[i]):
                            flow.text(t, style(kind, turned[i]))
                if len(flow.out) > 10_000:
                    done, flow.out = done + [(last, *x) for x in flow.out], []
            yield from _batch(done, kind_)
        end_row(None)
        yield from _batch([(last, *x) for x in flow.out], kind_)

    kind_ = pa_type(rows.schema[key].dataType)
    held = r.repartition(n, "_k").sortWithinPartitions("_k", "_o", "table", "row", "col")
    return held.mapInArrow(run, f"_k {kind}, {LAID}").withColumnRenamed("_k", key)


def _values(column: pa.Array) -> list:
    """to_pylist(), in one step for the types that have one."""
    plain = pa.types.is_integer(column.type) or pa.types.is_boolean(column.type)
    if column.null_count == len(column):
        return [None] * len(column)
    if pa.types.is_string(column.type) or plain and not column.null_count:
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def pa_type(spark_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(spark_type)


def _batch(rows: list[tuple], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    if rows:
        f, s = pa.float64(), pa.string()
        types = [key, pa.int32(), pa.int32(), s, f, f, f, f, f, f, s, pa.bool_(), s]
        names = ["_k", *(x.split()[0] for x in LAID.split(", "))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


# --- bytes --------------------------------------------------------------------------------------------------------


def _number(c: Column) -> Column:
    return F.format_string("%.3f", c)


def _color(c: Column) -> Column:
    parts = [F.format_string("%.3f", F.conv(F.substring(c, 1 + 2 * i, 2), 16, 10).cast("double") / 255) for i in range(3)]
    return F.concat_ws(" ", *parts)


def content(laid: DataFrame, key: str) -> DataFrame:
    """(key, page, ops): the operators of each page, its number at the foot included."""
    y = F.lit(PAGE_HEIGHT) - F.col("y")
    codes = F.when(F.col("latin"), F.hex(F.encode("text", "ISO-8859-1"))).otherwise(F.hex(F.encode("text", "UTF-16BE")))
    font = F.when(F.col("latin"), F.lit("/F1")).otherwise(F.lit("/F2"))
    base = y - fonts.ASCENT / 1000 * F.col("size")
    text = F.concat(F.lit("BT "), font, F.lit(" "), _number(F.col("size")), F.lit(" Tf "), _color(F.col("color")), F.lit(" rg "), _number(F.col("spacing")), F.lit(" Tw 1 0 0 1 "), _number(F.col("x")), F.lit(" "), _number(base), F.lit(" Tm <"), codes, F.lit("> Tj ET"))
    rect = F.concat_ws(" ", _number(F.col("x")), _number(y - F.col("height")), _number(F.col("width")), _number(F.col("height")), F.lit("re"))
    box = F.concat(F.lit("0.5 w "), _color(F.col("color")), F.lit(" RG "), rect, F.lit(" S"))
    fill = F.concat(_color(F.col("color")), F.lit(" rg "), rect, F.lit(" f"))
    op = F.when(F.col("op") == "text", text).when(F.col("op") == "box", box).otherwise(fill)
    held = laid.select(key, "page", "seq", op.alias("_op")).groupBy(key, "page").agg(F.array_sort(F.collect_list(F.struct("seq", "_op"))).alias("_a"))
    digits = F.col("page").cast("string")
    x = (PAGE_WIDTH - F.length(digits) * fonts.HELVETICA[0x30 - 0x20] * FOOTER_SIZE / 1000) / 2
    foot = F.concat(F.lit(f"BT /F1 {FOOTER_SIZE} Tf "), _color(F.lit(FOOTER_COLOR)), F.lit(" rg 0 Tw 1 0 0 1 "), _number(x), F.lit(f" {FOOTER - FOOTER_SIZE * fonts.ASCENT / 1000:.3f} Tm <"), F.hex(F.encode(digits, "ISO-8859-1")), F.lit("> Tj ET"))
    return held.select(key, "page", F.concat(F.array_join(F.col("_a._op"), "\n"), F.lit("\n"), foot).alias("ops"))


HEAD = "%PDF-1.4\n"
FIRST = 7  # number of the first page's object


def objects(pages: DataFrame, titles: DataFrame, key: str) -> DataFrame:
    """(key, num, body, start): the objects of each file, and where each starts; pages as content() gives them, titles
    (key, title) of the same documents."""
    counts = pages.groupBy(key).agg(F.max("page").alias("n")).join(titles.groupBy(key).agg(F.max("title").alias("title")), key, "left")
    kids = F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat((2 * i + FIRST - 2).cast("string"), F.lit(" 0 R"))), " ")
    wide = f"/DW {fonts.WIDE} /W [1 95 {fonts.NARROW}]"
    fixed = [
        F.lit("<< /Type /Catalog /Pages 2 0 R >>"),
        F.concat(F.lit("<< /Type /Pages /Kids ["), kids, F.lit("] /Count "), F.col("n").cast("string"), F.lit(f" /MediaBox [0 0 {PAGE_WIDTH} {PAGE_HEIGHT}] /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>")),
        F.lit("<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"),
        F.lit("<< /Type /Font /Subtype /Type0 /BaseFont /STSong-Light /Encoding /UniGB-UTF16-H /DescendantFonts [5 0 R] >>"),
        F.lit(f"<< /Type /Font /Subtype /CIDFontType0 /BaseFont /STSong-Light /CIDSystemInfo << /Registry (Adobe) /Ordering (GB1) /Supplement 4 >> {wide} >>"),
        F.concat(F.lit("<< /Title <FEFF"), F.hex(F.encode(F.coalesce("title", F.lit("")), "UTF-16BE")), F.lit("> >>")),
    ]
    top = counts.select(key, F.posexplode(F.array(*fixed)).alias("num", "text")).select(key, (F.col("num") + 1).alias("num"), "text")
    page = F.concat(F.lit("<< /Type /Page /Parent 2 0 R /Contents "), (2 * F.col("page") + FIRST - 1).cast("string"), F.lit(" 0 R >>"))
    stream = F.concat(F.lit("<< /Length "), F.length("ops").cast("string"), F.lit(" >>\nstream\n"), F.col("ops"), F.lit("\nendstream"))
    each = pages.select(key, F.explode(F.array(F.struct((2 * F.col("page") + FIRST - 2).alias("num"), page.alias("text")), F.struct((2 * F.col("page") + FIRST - 1).alias("num"), stream.alias("text")))).alias("o")).select(key, "o.*")
    body = F.concat(F.col("num").cast("string"), F.lit(" 0 obj\n"), F.col("text"), F.lit("\nendobj\n"))
    w = Window.partitionBy(key).orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
    start = len(HEAD) + F.coalesce(F.sum(F.length("body")).over(w), F.lit(0))
    return top.unionByName(each).select(key, "num", body.alias("body")).withColumn("start", start)


def pdf(rows: DataFrame, key: str, order: str, mode: str = "parallel") -> DataFrame:
    """(key, content) of rows as in layout(): a PDF file per document. All of a file is ASCII but what it shows is not."""
    obj = objects(content(layout(rows, key, order, mode), key), rows.select(key, "title"), key)
    held = obj.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("num", "start", "body"))).alias("_a"))
    places = F.array_join(F.transform("_a", lambda o: F.format_string("%010d 00000 n \n", o["start"])), "")
    last = F.get("_a", F.size("_a") - 1)
    size = (F.size("_a") + 1).cast("string")
    text = F.concat(F.lit(HEAD), F.array_join(F.col("_a.body"), ""), F.lit("xref\n0 "), size, F.lit("\n0000000000 65535 f \n"), places, F.lit("trailer\n<< /Size "), size, F.lit(" /Root 1 0 R /Info 6 0 R >>\nstartxref\n"), (last["start"] + F.length(last["body"])).cast("string"), F.lit("\n%%EOF\n"))
    return held.select(key, F.encode(text, "ISO-8859-1").alias("content"))
