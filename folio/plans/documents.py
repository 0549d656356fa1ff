"""The engine's calls: extract, translate, export. Each is a lazy plan over the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks as B
from ..operators import dispatch, progress, segment
from ..operators.spread import spread
from ..sources import files as S
from ..sources import ooxml, pdf


def extract(files: DataFrame) -> DataFrame:
    """(path, para_id, ord, text, kind, error) of files (path, name, ext, length, content): paragraphs of all formats.

    DOCX bodies are rebuilt from their raw paragraphs, PDF pages from the items they show; other formats are split as text. A failed file is one row.
    """
    pages = F.coalesce((F.col("ext") == "pdf") & F.col("content").isNotNull(), F.lit(False))
    docx, other, paged = files.where("ext = 'docx'"), files.where((F.col("ext") != "docx") & ~pages), files.where(pages)
    flat = S.extract_text(other)
    parts = flat.select("path", "error", F.posexplode_outer(segment.split_paragraphs(F.col("text"))).alias("_i", "text"))
    parts = parts.where("error is not null or text is not null").select("path", F.concat(F.lit("p-"), F.col("_i") + 1).alias("para_id"), (F.col("_i") + 1).cast("long").alias("ord"), "text", F.lit("paragraph").alias("kind"), "error")
    body, cells = docx_blocks(docx)
    paras = B.body_paragraphs(body, "path").withColumn("error", F.lit(None).cast("string"))
    ident = F.concat(F.lit("table-"), F.col("table_no"), F.lit("-r"), F.col("row"), F.lit("-c"), F.col("col"))
    cells = cells.where(segment.translatable(F.col("text"))).select("path", ident.alias("para_id"), F.lit(None).cast("long").alias("ord"), "text", F.lit("table-cell").alias("kind"), F.lit(None).cast("string").alias("error"))
    failed = ooxml.raw_paragraphs(docx).where("error is not null").select("path", F.lit(None).cast("string").alias("para_id"), F.lit(None).cast("long").alias("ord"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("kind"), "error")
    return parts.unionByName(paras.select(*parts.columns)).unionByName(cells).unionByName(failed).unionByName(pdf.paragraphs(paged))


def _folded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Folded bodies (path, part) and cells (path, table_no, row, col) of DOCX files.

    A table ends a run of paragraphs, so runs are folded by themselves. A file's rows stay together from here on, so that
    all that is grouped below files needs no further shuffle.
    """
    raw = spread(ooxml.raw_paragraphs(files).where("error is null"), "path").withColumn("text", text.normalize_extracted(F.col("text")))
    full = B.classify(raw)
    return B.fold(full.where("table_no = 0"), ["path", "part"]), B.fold(full.where("table_no > 0"), ["path", "table_no", "row", "col"])


def docx_blocks(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Blocks (path, ord ...) of the bodies of DOCX files, and their table cells (path, table_no, row, col, text, shown);
    shown counts the pictures and formulas of a cell."""
    runs, cells = _folded(files)
    body = B.blocks(runs, ["path", "part"])
    body = body.withColumn("ord", F.col("part") * F.lit(1 << 32) + F.col("ord"))
    texts = F.transform(F.filter("blocks", lambda b: b["type"] == "paragraph"), lambda b: b["text"])
    shown = F.size(F.filter("blocks", lambda b: b["type"] != "paragraph"))
    return body, cells.select("path", "table_no", "row", "col", F.array_join(texts, "\n").alias("text"), shown.alias("shown"))


def docx_counters(files: DataFrame) -> DataFrame:
    """(path, formulas, furniture, duplicates, merged, images): what the rebuilding of each DOCX file came upon; images
    are those of the body."""
    names = ["formulas", "furniture", "duplicates", "merged"]
    raw = spread(ooxml.raw_paragraphs(files).where("error is null"), "path").withColumn("text", text.normalize_extracted(F.col("text")))
    all_ = B.fold(B.classify(raw), ["path", "part", "table_no", "row", "col"])  # a run of paragraphs, or a cell
    images = F.when(F.col("table_no") == 0, F.size(F.filter("blocks", lambda b: b["type"] == "image"))).otherwise(0)
    rows = all_.select("path", *names, images.alias("images"))
    return rows.groupBy("path").agg(*(F.sum(n).cast("long").alias(n) for n in [*names, "images"]))


def docx_tables(cells: DataFrame) -> DataFrame:
    """(path, table_no, columns, rows) of docx_blocks()'s cells: rows with any text, picture or formula, the first row of
    a table marked as header, and the width of the widest row that is left."""
    rows = cells.groupBy("path", "table_no", "row").agg(F.array_sort(F.collect_list(F.struct("col", "text", "shown"))).alias("cells"))
    rows = rows.where(F.exists("cells", lambda c: (c["text"] != "") | (c["shown"] > 0)))
    row = F.struct("row", (F.col("row") == 1).alias("header"), F.transform("cells", lambda c: c["text"]).alias("cells"))
    return rows.groupBy("path", "table_no").agg(F.max(F.size("cells")).alias("columns"), F.array_sort(F.collect_list(row)).alias("rows"))


def translate(paragraphs: DataFrame, translator: dispatch.Translator, done: DataFrame | None = None, **limits) -> DataFrame:
    """Results of the paragraphs (doc_id, id, text) that have none in done (doc_id, id)."""
    units = segment.request_units(paragraphs)
    if done is not None:
        units = progress.unfinished(units, done, ["doc_id", "id"])
    return dispatch.translate(units, translator, **limits)
