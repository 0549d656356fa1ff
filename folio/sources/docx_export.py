"""DOCX files from export rows: paragraphs by kind, tables, pictures and a footer with the page number.

The XML of every block is a column expression. Pictures are told apart by their digest: a dense rank of the digests per
document numbers its media parts and relations, so equal pictures are stored once. One small helper zips the parts of
a document, in a fixed order and with a fixed time, so equal rows give equal bytes.

Defined cases: pictures of kinds other than PNG, JPEG, GIF and BMP, without data or without an asset of their name show
their LaTeX as a caption, or nothing; a null or empty text gives no paragraph; characters that XML can't hold are dropped;
a document without blocks has its title alone.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js, numbers
from ..operators.exports import text_parts
from ..operators.spread import spread

# Namespaces and types of the format's parts.
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
KINDS = {"image/png": "png", "image/jpeg": "jpg", "image/jpg": "jpg", "image/gif": "gif", "image/bmp": "bmp"}
MIME = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp"}
EMU = 9525  # of a pixel
BATCH = 1 << 20  # bytes of files that a task holds before it passes them on
# Fixed values of the look: half-points, twentieths of a point, colours.
SIZES = {"heading": 27, "caption": 19, "table-cell": 19}
SIZE, FIRST_LINE, LINE, FONT, OWN_FONT = 21, 420, 330, "Microsoft YaHei", "Times New Roman"
COLOR, CAPTION_COLOR, TRANSLATED_COLOR, FOOTER_COLOR, FOOTER_SIZE = "172033", "667085", "4F5E73", "8A94A6", 17
HEADER_FILL, EDGE, INNER = "EEF3FA", "C8D1DE", "DCE3EC"
PAGE = '<w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="1134" w:right="1247" w:bottom="1134" w:left="1247" w:header="708" w:footer="708" w:gutter="0"/>'

_OVERRIDES = "".join(f'<Override PartName="/word/{n}.xml" ContentType="{TYPE}.{t}+xml"/>' for n, t in (("document", "document.main"), ("styles", "styles"), ("footer1", "footer")))
TYPES = f'{XML}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{"".join(f"<Default Extension={chr(34)}{e}{chr(34)} ContentType={chr(34)}{m}{chr(34)}/>" for e, m in MIME.items())}{_OVERRIDES}</Types>'
RELS = f'{XML}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'
FOOTER = f'{XML}<w:ftr xmlns:w="{WORD}"><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:rPr><w:color w:val="{FOOTER_COLOR}"/><w:sz w:val="{FOOTER_SIZE}"/></w:rPr><w:fldChar w:fldCharType="begin"/><w:instrText xml:space="preserve">PAGE</w:instrText><w:fldChar w:fldCharType="end"/></w:r></w:p></w:ftr>'
_STYLE = lambda i, n: f'<w:style w:type="paragraph" w:styleId="{i}"><w:name w:val="{n}"/></w:style>'
STYLES = f'{XML}<w:styles xmlns:w="{WORD}"><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:eastAsia="{FONT}"/><w:sz w:val="{SIZE}"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:line="{LINE}"/></w:pPr></w:pPrDefault></w:docDefaults>{_STYLE("Title", "Title")}{_STYLE("Heading1", "heading 1")}{_STYLE("Caption", "caption")}{_STYLE("ListParagraph", "List Paragraph")}</w:styles>'


def escaped(c: Column) -> Column:
    c = F.regexp_replace(js.text(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _cat(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def paragraph(t: Column, kind: Column, translated: Column, first_line: int) -> Column:
    """A paragraph of text: headings bold unless translated, captions and translations in italics."""
    heading, caption, cell = (kind == k for k in ("heading", "caption", "table-cell"))
    own_heading = heading & ~translated
    style = F.when(own_heading, '<w:pStyle w:val="Heading1"/>').when(caption, '<w:pStyle w:val="Caption"/>').when(kind == "list-item", '<w:pStyle w:val="ListParagraph"/>').otherwise("")
    before = F.when(heading, 250).otherwise(0).cast("string")
    after = F.when(translated, 240).when(caption, 200).otherwise(100).cast("string")
    indent = F.when(heading | caption | cell | (kind == "list-item") | F.lit(not first_line), "").otherwise(f'<w:ind w:firstLine="{first_line}"/>')
    align = F.when(caption, "center").otherwise("both")
    font = F.when(translated, FONT).otherwise(OWN_FONT)
    look = _cat(F.when(own_heading, "<w:b/>").otherwise(""), F.when(caption | translated, "<w:i/>").otherwise(""), '<w:color w:val="', F.when(translated, TRANSLATED_COLOR).when(caption, CAPTION_COLOR).otherwise(COLOR), '"/>')
    size = F.when(heading, SIZES["heading"]).when(caption | cell, SIZES["caption"]).otherwise(SIZE).cast("string")
    fonts = _cat('<w:rFonts w:ascii="', font, '" w:hAnsi="', font, '" w:eastAsia="', font, '"/>')
    return _cat("<w:p><w:pPr>", style, '<w:spacing w:before="', before, '" w:after="', after, f'" w:line="{LINE}"/>', indent, '<w:jc w:val="', align, '"/></w:pPr><w:r><w:rPr>', fonts, look, '<w:sz w:val="', size, '"/></w:rPr><w:t xml:space="preserve">', escaped(t), "</w:t></w:r></w:p>")


def table(t: Column) -> Column:
    """A table of a text with tabs between cells and line ends between rows; the first row is its header."""
    no = F.lit(False)
    fill = f'<w:shd w:val="clear" w:fill="{HEADER_FILL}"/>'
    pad = '<w:tcMar><w:top w:w="90"/><w:left w:w="110"/><w:bottom w:w="90"/><w:right w:w="110"/></w:tcMar>'
    cell = lambda c, i: _cat("<w:tc><w:tcPr>", F.when(i == 0, fill).otherwise(""), pad, "</w:tcPr>", F.when(c == "", "<w:p/>").otherwise(paragraph(c, F.lit("table-cell"), no, 0)), "</w:tc>")
    row = lambda r, i: _cat("<w:tr>", F.when(i == 0, "<w:trPr><w:tblHeader/></w:trPr>").otherwise(""), F.array_join(F.transform(F.split(r, "\t", -1), lambda c: cell(c, i)), ""), "</w:tr>")
    edges = "".join(f'<w:{s} w:val="single" w:sz="{2 if s in ("top", "bottom", "left", "right") else 1}" w:color="{EDGE if s in ("top", "bottom", "left", "right") else INNER}"/>' for s in ("top", "left", "bottom", "right", "insideH", "insideV"))
    return _cat(f'<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/><w:tblBorders>{edges}</w:tblBorders></w:tblPr>', F.array_join(F.transform(F.split(t, "\n", -1), row), ""), "</w:tbl>")


def picture(rel: Column, n: Column, width: Column, height: Column, alt: Column) -> Column:
    """A centred picture, scaled into the page."""
    w, h = numbers.image_size(width, height)
    cx, cy, number = (w * EMU).cast("string"), (h * EMU).cast("string"), n.cast("string")
    ext = _cat('cx="', cx, '" cy="', cy, '"/>')
    inner = _cat(f'<a:graphic xmlns:a="{DRAWING}/main"><a:graphicData uri="{DRAWING}/picture"><pic:pic xmlns:pic="{DRAWING}/picture"><pic:nvPicPr><pic:cNvPr id="', number, '" name=""/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="', rel, '"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext ', ext, '</a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic></a:graphicData></a:graphic>')
    return _cat('<w:p><w:pPr><w:spacing w:before="100" w:after="220"/><w:jc w:val="center"/></w:pPr><w:r><w:drawing><wp:inline><wp:extent ', ext, '<wp:docPr id="', number, '" name="" descr="', escaped(alt), '"/>', inner, "</wp:inline></w:drawing></w:r></w:p>")


def _zipped(document: str, names: list[str], data: list[bytes]) -> bytes:
    rel = lambda i, kind, target: f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>'
    rels = f'{XML}<Relationships xmlns="{PACKAGE}/relationships">{rel("f1", "footer", "footer1.xml")}{rel("s1", "styles", "styles.xml")}{"".join(rel(f"p{i}", "image", f"media/{n}") for i, n in enumerate(names, 1))}</Relationships>'
    parts = [("[Content_Types].xml", TYPES), ("_rels/.rels", RELS), ("word/document.xml", document), ("word/_rels/document.xml.rels", rels), ("word/styles.xml", STYLES), ("word/footer1.xml", FOOTER)]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in parts + [(f"word/media/{n}", d) for n, d in zip(names, data, strict=True)]:
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), part)
    return out.getvalue()


def docx(rows: DataFrame, key: str, order: str, title: str, mode: str = "parallel", assets: DataFrame | None = None, first_line: int = FIRST_LINE) -> DataFrame:
    """(key, content) of rows (key, order, title, kind, source, translation): a DOCX file per document.

    Rows of kind image or formula have asset_id, latex, width, height and alt; assets are (key, asset_id, mime_type, data).
    first_line: the indent of plain paragraphs.
    """
    shown = ["asset_id", "latex", "width", "height", "alt"]
    kinds = {"asset_id": "string", "latex": "string", "width": "double", "height": "double", "alt": "string"}
    r = rows.select(F.col(key).alias("_k"), F.col(order).alias("_o"), F.col(title).alias("_title"), F.coalesce("kind", F.lit("paragraph")).alias("kind"), "source", "translation", *(F.col(c).cast(kinds[c]) if c in rows.columns else F.lit(None).cast(kinds[c]).alias(c) for c in shown))
    visual = F.col("kind").isin("image", "formula")
    text = r.where(~visual).select("_k", "_o", "_title", "kind", F.posexplode_outer(text_parts(F.col("source"), F.col("translation"), mode)).alias("_n", "p"))
    plain = text.select("_k", "_o", "_n", "_title", F.when(F.col("p").isNull(), None).when(F.col("kind") == "table", _cat(table(F.col("p.text")), '<w:p><w:pPr><w:spacing w:after="180"/></w:pPr></w:p>')).otherwise(paragraph(F.col("p.text"), F.col("kind"), F.col("p.translated"), first_line)).alias("xml"))
    media = None
    seen = r.where(visual).withColumn("_n", F.lit(0))
    caption = F.when(js.text(F.col("latex")) != "", paragraph(F.col("latex"), F.lit("caption"), F.lit(False), 0))
    if assets is not None:
        known = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
        held = assets.select(F.col(key).alias("_k"), "asset_id", F.try_element_at(known, F.lower("mime_type")).alias("ext"), "data", F.sha2("data", 256).alias("digest"))
        held = held.where("ext is not null and data is not null").dropDuplicates(["_k", "asset_id"])
        used = held.join(seen.select("_k", "asset_id").distinct(), ["_k", "asset_id"], "left_semi")
        used = used.withColumn("n", F.dense_rank().over(Window.partitionBy("_k").orderBy("digest")))
        media = used.groupBy("_k", "n").agg(F.min(F.struct("ext", "data")).alias("m")).groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("n", "m.ext", "m.data"))).alias("media"))
        seen = seen.join(used.select("_k", "asset_id", "n"), ["_k", "asset_id"], "left")
        caption = F.when(F.col("n").isNotNull(), picture(_cat("p", F.col("n").cast("string")), F.col("n"), F.col("width"), F.col("height"), F.col("alt"))).otherwise(caption)
    both = plain.unionByName(seen.select("_k", "_o", "_n", "_title", caption.alias("xml")))
    block = F.when(F.col("xml").isNotNull(), F.struct("_o", "_n", "xml"))  # every row has its title, not every one a block
    docs = spread(both, "_k").groupBy("_k").agg(F.max("_title").alias("_title"), F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["xml"]), "").alias("body"))
    top = F.when(js.text(F.col("_title")) == "", "").otherwise(_cat('<w:p><w:pPr><w:pStyle w:val="Title"/><w:spacing w:after="480"/><w:jc w:val="center"/></w:pPr><w:r><w:t xml:space="preserve">', escaped(F.col("_title")), "</w:t></w:r></w:p>"))
    head = f'{XML}<w:document xmlns:w="{WORD}" xmlns:r="{OFFICE}" xmlns:wp="{DRAWING}/wordprocessingDrawing"><w:body>'
    docs = docs.select("_k", _cat(head, top, F.col("body"), f'<w:sectPr><w:footerReference w:type="default" r:id="f1"/>{PAGE}</w:sectPr></w:body></w:document>').alias("document"))
    none = F.array().cast("array<struct<n:int,ext:string,data:binary>>")
    docs = docs.join(media, "_k", "left").withColumn("media", F.coalesce("media", none)) if media is not None else docs.withColumn("media", none)
    docs = docs.select("_k", "document", F.transform("media", lambda m: _cat("image", m["n"].cast("string"), ".", m["ext"])).alias("names"), F.transform("media", lambda m: m["data"]).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for i in range(b.num_rows):  # a document at a time, as its pictures may be large
                k, doc, names, data = (b.column(c)[i].as_py() for c in ("_k", "document", "names", "data"))
                out.append((k, _zipped(doc, names, data)))
                size += len(out[-1][1])
                if size > BATCH or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], b.schema.field("_k").type), pa.array([x[1] for x in out], pa.binary())], ["_k", "content"])
                    out, size = [], 0

    return docs.mapInArrow(run, f"_k {rows.schema[key].dataType.simpleString()}, content binary").withColumnRenamed("_k", key)
