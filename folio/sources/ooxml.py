"""DOCX, XLSX and PPTX files by the standard library's zip and XML readers.

The only Python step is bytes to raw rows, in Arrow batches over binaryFile rows; all rules on text are column
expressions. Entity declarations are refused and the unpacked size is bounded, as files are untrusted.
"""

from __future__ import annotations

import html
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

MAX_UNPACKED = 400 * 1024 * 1024
BATCH = 1 << 20  # bytes of files that a task reads before it passes their rows on
_CODE = re.compile(r"&#([0-9]+);")
# Entities in the order in which they are decoded; media types by extension.
_NAMED = [(re.compile(name, re.I), char) for name, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))]
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "tif": "image/tiff", "tiff": "image/tiff", "svg": "image/svg+xml", "webp": "image/webp", "emf": "image/emf", "wmf": "image/wmf"}


def entities(s: str) -> str:
    if "&" not in s:
        return s
    for name, char in _NAMED:
        s = name.sub(char, s)
    return _CODE.sub(lambda m: chr(n) if not 0xD800 <= (n := int(m[1]) % 65536) <= 0xDFFF else "�", s)


def parsed(data: bytes) -> ElementTree.Element:
    if b"<!ENTITY" in data or b"<!DOCTYPE" in data:
        raise ValueError("declarations of entities are refused")
    return ElementTree.fromstring(data)


class Package:
    """A zip of bounded unpacked size."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = self.zip.namelist()
        if sum(i.file_size for i in self.zip.infolist()) > MAX_UNPACKED:
            raise ValueError("the file unpacks to more than the limit")

    def text(self, name: str) -> str:
        return self.zip.read(name).decode("utf-8", "replace") if name in self.names else ""

    def xml(self, name: str) -> ElementTree.Element:
        return parsed(self.zip.read(name))

    def numbered(self, pattern: str) -> list[str]:
        """Parts whose name fits, by their number."""
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n, re.I))]
        return [n for _, n in sorted(found, key=lambda x: x[0])]


def pptx_text(content: bytes) -> str:
    """Texts of each slide joined by spaces, slides by blank lines."""
    p = Package(content)
    slides = []
    for name in p.numbered(r"ppt/slides/slide(\d+)\.xml"):
        slides.append(" ".join(entities(t) for t in re.findall(r"(?is)<a:t[^>]*>(.*?)</a:t>", p.text(name))).strip())
    return "\n\n".join(s for s in slides if s)


_CELL, _VALUE, _TEXT = re.compile(r"(?is)<c([^>]*)>(.*?)</c>"), re.compile(r"(?is)<v[^>]*>(.*?)</v>"), re.compile(r"(?is)<t[^>]*>(.*?)</t>")
_KIND, _DIGITS = re.compile(r'\bt="([^"]+)"'), re.compile(r"\d*")
_ITEM, _ROW = re.compile(r"(?is)<si>(.*?)</si>"), re.compile(r"(?is)<row[^>]*>(.*?)</row>")


def xlsx_row(cells: str, shared: list[str]) -> list[str]:
    """Values of a row's XML. Addresses are not looked at, and an element that ends at once takes the next with it."""
    out = []
    for attrs, body in _CELL.findall(cells):
        found = _VALUE.search(body)
        raw = found[1] if found and found[1] else ""
        if not raw:
            found = _TEXT.search(body)
            raw = found[1] if found else ""
        kind = _KIND.search(attrs) if attrs else None
        if kind and kind[1] == "s":
            n = raw.strip()
            at = int(n or 0) if _DIGITS.fullmatch(n) else -1
            out.append(shared[at] if 0 <= at < len(shared) else "")
        else:
            out.append(entities(raw))
    return out


def xlsx_text(content: bytes) -> str:
    """Rows of each sheet joined by tabs under the sheet's number in order."""
    p = Package(content)
    shared = ["".join(entities(t) for t in _TEXT.findall(si)) for si in _ITEM.findall(p.text("xl/sharedStrings.xml"))]
    sheets = []
    for i, name in enumerate(p.numbered(r"xl/worksheets/sheet(\d+)\.xml")):
        rows = [xlsx_row(r, shared) for r in _ROW.findall(p.text(name))]
        rows = ["\t".join(r) for r in rows if any(r)]
        if rows:
            sheets.append(f"【Sheet {i + 1}】\n" + "\n".join(rows))
    return "\n\n".join(sheets)


# --- DOCX ---------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=4096)
def _bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def _local(node) -> str:
    return _bare(node.tag)  # the parser keeps no comments, so each tag is a string


def _all(node, name: str) -> list:
    return [] if node is None else [x for x in node.iter() if _bare(x.tag) == name and x is not node]


def _first(node, name: str):
    return None if node is None else next((x for x in node.iter() if _bare(x.tag) == name and x is not node), None)


def _by_name(node) -> dict[str, list]:
    """All elements below a node by their names, each in order: one pass, however many names are asked for."""
    found: dict[str, list] = {}
    if node is not None and len(node):
        below = node.iter()
        next(below)  # the node itself comes first
        for x in below:
            found.setdefault(_bare(x.tag), []).append(x)
    return found


def _attr(node, name: str) -> str:
    if node is not None:
        for k, v in node.attrib.items():
            if _bare(k) == name:
                return v
    return ""


def _number(s: str) -> float:
    try:
        return float(s or 0)
    except ValueError:
        return 0.0


def _content(node) -> str:
    """Texts of a paragraph in order, tabs and line breaks as white space."""
    name = _local(node)
    if name == "t":
        return "".join(node.itertext())
    return "\t" if name == "tab" else " " if name == "br" else "".join(map(_content, node))


def _text(node, found: dict[str, list]) -> str:
    """_content() of a paragraph whose elements are known: without tabs, breaks and elements in its texts, these in a row."""
    texts = found.get("t", [])
    if "tab" in found or "br" in found or any(map(len, texts)):
        return _content(node)
    return "".join([t.text or "" for t in texts])


def latex(node) -> str:
    """Office math as LaTeX."""
    if node is None:
        return ""
    kids = {_local(k): k for k in reversed(list(node))}
    part = lambda n: latex(kids.get(n))
    name = _local(node)
    rules: dict[str, Callable[[], str]] = {
        "t": lambda: "".join(node.itertext()),
        "f": lambda: rf"\frac{{{part('num')}}}{{{part('den')}}}",
        "sSup": lambda: f"{{{part('e')}}}^{{{part('sup')}}}",
        "sSub": lambda: f"{{{part('e')}}}_{{{part('sub')}}}",
        "sSubSup": lambda: f"{{{part('e')}}}_{{{part('sub')}}}^{{{part('sup')}}}",
        "rad": lambda: rf"\sqrt{{{part('e')}}}",
        "d": lambda: rf"\left({part('e')}\right)",
        "acc": lambda: rf"\hat{{{part('e')}}}",
        "limLow": lambda: f"{part('e')}_{{{part('lim')}}}",
        "limUpp": lambda: f"{part('e')}^{{{part('lim')}}}",
        "m": lambda: r"\begin{matrix}" + r" \\ ".join(" & ".join(latex(e) for e in r if _local(e) == "e") for r in node if _local(r) == "mr") + r"\end{matrix}",
    }
    if name == "nary":
        sign = "".join("".join(t.itertext()) for t in _all(kids.get("naryPr"), "t"))
        command = r"\int" if "∫" in sign else r"\prod" if "∏" in sign else r"\sum"
        return f"{command}_{{{part('sub')}}}^{{{part('sup')}}} {part('e')}"
    if name in rules:
        return rules[name]()
    return "".join(map(latex, node))


def _pixels(extent, shape) -> tuple[int, int]:
    """A drawing's size: from its extent, else from a shape's style, else 640 x 360."""
    per = {"pt": 96 / 72, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "px": 1.0}

    def side(attr: str, style: str, default: float) -> int:
        m = re.search(rf"{style}\s*:\s*([0-9.]+)(pt|px|in|cm|mm)?", _attr(shape, "style"), re.I)
        v = _number(_attr(extent, attr)) / 9525 or (_number(m[1]) * per[(m[2] or "px").lower()] if m else 0) or default
        return max(1, int(v + 0.5))

    return side("cx", "width", 640), side("cy", "height", 360)


@lru_cache(maxsize=64)
def _relations(data: bytes) -> list[tuple[str, str]]:
    """(id, path) of the relations of a document's part to others of its file; files without pictures share their bytes."""
    all_ = [(_attr(r, "Id"), _attr(r, "Target"), _attr(r, "TargetMode")) for r in _all(parsed(data), "Relationship")]
    return [(rel, posixpath.normpath(posixpath.join("word", target.replace("\\", "/")))) for rel, target, mode in all_ if rel and target and mode != "External"]


def assets(p: Package) -> tuple[list[dict], dict[str, str]]:
    """Media parts in the order of their relations, each once, and the asset of each relation."""
    name = "word/_rels/document.xml.rels"
    found, by_path, by_rel = [], {}, {}
    for rel, path in _relations(p.zip.read(name)) if name in p.names else []:
        if path not in p.names or not path.startswith("word/media/"):
            continue
        if path not in by_path:
            by_path[path] = f"asset-{len(found) + 1}"
            found.append({"asset_id": by_path[path], "mime_type": MEDIA.get(path.rpartition(".")[2].lower(), "application/octet-stream"), "data": p.zip.read(path), "source_path": path})
        by_rel[rel] = by_path[path]
    return found, by_rel


_BARE = {"text": "", "style": "", "left": 0.0, "first_line": 0.0, "hanging": 0.0, "spacing_before": 0.0, "line_height": 0.0, "exact_line": False, "max_font_size": 0.0, "justification": "", "list": False, "drawing": False, "drawing_width": 0.0, "drawing_height": 0.0, "latex": "", "visuals": []}


def _paragraph(node, by_rel: dict[str, str]) -> dict:
    if not len(node):
        return _BARE | {"text": _content(node)}
    found = _by_name(node)
    one = lambda n: found[n][0] if n in found else None
    own = _by_name(one("pPr"))
    prop = lambda n: own[n][0] if n in own else None
    indent, spacing, extent = prop("ind"), prop("spacing"), one("extent")
    math = found.get("oMathPara") or found.get("oMath") or []
    rels = dict.fromkeys([_attr(b, "embed") for b in found.get("blip", [])] + [_attr(b, "id") for b in found.get("imagedata", [])])
    visuals = [r for r in rels if r in by_rel]
    width, height = _pixels(extent, one("shape")) if visuals else (0, 0)
    about = one("docPr")
    alt = _attr(about, "descr") or _attr(about, "title") or _attr(about, "name")
    return {
        "text": _text(node, found),
        "style": _attr(prop("pStyle"), "val"),
        "left": _number(_attr(indent, "left")),
        "first_line": _number(_attr(indent, "firstLine")),
        "hanging": _number(_attr(indent, "hanging")),
        "spacing_before": _number(_attr(spacing, "before")),
        "line_height": _number(_attr(spacing, "line")),
        "exact_line": _attr(spacing, "lineRule") == "exact",
        "max_font_size": max([0.0, *(_number(_attr(s, "val")) for s in found.get("sz", []))]),
        "justification": _attr(prop("jc"), "val"),
        "list": "numPr" in own,
        "drawing": "drawing" in found or "pict" in found,
        "drawing_width": _number(_attr(extent, "cx")),
        "drawing_height": _number(_attr(extent, "cy")),
        "latex": r" \\ ".join(dict.fromkeys(x for m in math if (x := latex(m).strip()))) if math else "",
        "visuals": [{"asset_id": by_rel[r], "width": width, "height": height, "alt": alt} for r in visuals],
    }


RAW = "text string, style string, left double, first_line double, hanging double, spacing_before double, line_height double, exact_line boolean, max_font_size double, justification string, list boolean, drawing boolean, drawing_width double, drawing_height double, latex string, visuals array<struct<asset_id:string,width:int,height:int,alt:string>>"


def docx_rows(content: bytes) -> list[dict]:
    """Raw paragraphs of a document's body in order: part (run of paragraphs or table), table, row and cell."""
    p = Package(content)
    return _body_rows(p, assets(p)[1])


def _body_rows(p: Package, by_rel: dict[str, str]) -> list[dict]:
    if "word/document.xml" not in p.names:
        raise ValueError("no word/document.xml")
    body = _first(p.xml("word/document.xml"), "body")
    if body is None:
        raise ValueError("no body")
    out, part, table = [], 0, 0
    for node in body:
        if _local(node) == "p":
            out.append({"part": part, "table_no": 0, "row": 0, "col": 0, **_paragraph(node, by_rel)})
        elif _local(node) == "tbl":
            part, table = part + 1, table + 1
            for r, row in enumerate((x for x in node if _local(x) == "tr"), 1):
                for c, cell in enumerate((x for x in row if _local(x) == "tc"), 1):
                    out += [{"part": part, "table_no": table, "row": r, "col": c, **_paragraph(x, by_rel)} for x in _all(cell, "p")] or [{"part": part, "table_no": table, "row": r, "col": c, "text": ""}]
            part += 1
    return [{"seq": i, **r} for i, r in enumerate(out)]


def _per_file(files: DataFrame, read: Callable[[str, bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that read() makes of each file, with its path; a file that fails gives one row with the error."""
    whole = f"path string, error string, {schema}"
    kind = to_arrow_schema(DataType.fromDDL(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            size = 0
            for i in range(b.num_rows):
                path, ext, content = (b.column(c)[i].as_py() for c in ("path", "ext", "content"))
                try:
                    if content is None:
                        raise ValueError("larger than the limit")
                    out += [{"path": path, "error": None, **r} for r in read(ext, content)]
                except Exception as e:  # one file's failure is its own row
                    out.append({"path": path, "error": f"{type(e).__name__}: {e}"})
                size += len(content or b"")
                if out and (size > BATCH or i + 1 == b.num_rows):
                    yield pa.RecordBatch.from_pylist(out, kind)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return files.select("path", "ext", "content").mapInArrow(run, whole)


def raw_paragraphs(files: DataFrame) -> DataFrame:
    """(path, error, seq, part, table_no, row, col, text and metadata) of DOCX files."""
    return _per_file(files, lambda _, c: docx_rows(c), f"seq long, part int, table_no int, row int, col int, {RAW}")


_ASSET = "asset_id string, mime_type string, data binary, source_path string"


def docx_assets(files: DataFrame) -> DataFrame:
    """(path, error, asset_id, mime_type, data, source_path) of DOCX files."""
    return _per_file(files, lambda _, c: assets(Package(c))[0], _ASSET)


def docx_contents(files: DataFrame) -> DataFrame:
    """Rows of docx_assets() (seq is null) and of raw_paragraphs() (asset_id is null) in one table, each file read once."""

    def read(_: str, content: bytes) -> list[dict]:
        p = Package(content)
        found, by_rel = assets(p)
        return found + _body_rows(p, by_rel)

    return _per_file(files, read, f"{_ASSET}, seq long, part int, table_no int, row int, col int, {RAW}")


def docx_facts(files: DataFrame) -> DataFrame:
    """(path, error, page_count, column_count) of DOCX files."""

    def read(_: str, content: bytes) -> list[dict]:
        p = Package(content)
        pages = re.search(r"(?i)<(?:\w+:)?Pages\b[^>]*>(\d+)</(?:\w+:)?Pages>", p.text("docProps/app.xml"))
        columns = [int(_number(_attr(c, "num")) or 1) for c in _all(p.xml("word/document.xml"), "cols")]
        return [{"page_count": int(pages[1]) if pages else None, "column_count": max([1, *columns])}]

    return _per_file(files, read, "page_count int, column_count int")


def office_text(files: DataFrame) -> DataFrame:
    """(path, name, ext, text, error) of office files; a DOCX's text is its paragraphs, unfolded."""

    def read(ext: str, content: bytes) -> list[dict]:
        if ext == "docx":
            return [{"text": "\n\n".join(r["text"] for r in docx_rows(content) if r["text"].strip())}]
        return [{"text": xlsx_text(content) if ext == "xlsx" else pptx_text(content)}]

    found = _per_file(files, read, "text string")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1)).withColumn("ext", F.lower(F.substring_index("name", ".", -1))).select("path", "name", "ext", "text", "error")


def escape(s: str) -> str:
    return html.escape(s, quote=True)
