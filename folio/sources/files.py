"""Files as documents: listing, dispatch by extension, whole-file text."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

TEXT = ["txt", "md", "csv", "tsv", "json"]
HTML = ["html", "htm"]
SUPPORTED = [*TEXT, *HTML, "docx", "pdf", "xlsx", "pptx"]
MAX_BYTES = 40 * 1024 * 1024


def supported(name: Column) -> Column:
    return text.extension(name).isin(SUPPORTED)


def read_files(spark: SparkSession, folder: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, name, ext, length, content) of supported files in a folder and those below it.

    Files over max_bytes keep their row with a null content, for quarantine.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(supported(F.col("name")))
    fits = F.col("length") <= max_bytes
    return f.select("path", "name", text.extension(F.col("name")).alias("ext"), "length", F.when(fits, F.col("content")).alias("content"))


def in_reading_order(files: DataFrame) -> DataFrame:
    """Sorted by path as Chinese readers expect (Han before Latin)."""
    return files.orderBy(F.collate("path", "zh"))


def extract_text(files: DataFrame) -> DataFrame:
    """(path, name, ext, text, error): plain and HTML files as text; office files through ooxml, PDF through pdf; else an
    error.

    No failure ends the job: what can't be read has a null text and says why.
    """
    from . import ooxml, pdf

    raw = F.decode("content", "UTF-8")
    pages = F.coalesce(F.col("ext") == "pdf", F.lit(False)) & F.col("content").isNotNull()
    flat = files.where((F.col("ext").isin(TEXT + HTML) | ~F.col("ext").isin("xlsx", "pptx", "docx")) & ~pages)
    known = F.when(F.col("content").isNull(), F.lit(None)).when(F.col("ext").isin(TEXT), text.normalize(raw)).when(F.col("ext").isin(HTML), text.strip_html(raw))
    why = F.when(F.col("content").isNull(), F.concat(F.lit("larger than the limit: "), F.col("length").cast("string"))).when(~F.col("ext").isin(TEXT + HTML), F.concat(F.lit("no reader for "), F.col("ext")))
    plain = flat.select("path", "name", "ext", known.alias("text"), why.alias("error"))
    office = ooxml.office_text(files.where(F.col("ext").isin("xlsx", "pptx", "docx")))
    plain = plain.unionByName(pdf.text(files.where(pages)))
    return plain.unionByName(office.select("path", "name", "ext", text.normalize(F.col("text")).alias("text"), "error"))


def new_folder(spark: SparkSession, name: str) -> str:
    """A path that no other call has, under spark.checkpoint.dir. One of our own is made only in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="folio-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def json_settings(files: list[str]) -> dict:
    """The first of some JSON files that is there and can be read; else nothing."""
    for name in files:
        try:
            with open(name, encoding="utf-8") as f:
                return json.load(f)
        except (OSError, ValueError):
            continue
    return {}


def save_settings(name: str, values: dict) -> None:
    """Write settings as JSON, by a new file that takes the place of the old one."""
    os.makedirs(os.path.dirname(os.path.abspath(name)), exist_ok=True)
    with open(f"{name}.new", "w", encoding="utf-8") as f:
        f.write(json.dumps(values, ensure_ascii=False, indent=2) + "\n")
    os.replace(f"{name}.new", name)


def settings(environment: dict[str, str] | None = None, files: list[str] | None = None, json_files: list[str] | None = None) -> dict[str, str]:
    """KEY=value files, first value wins, quotes stripped; the environment goes before them, texts of JSON files last."""
    out: dict[str, str] = {}
    for name in files or []:
        if os.path.exists(name):
            with open(name, encoding="utf-8") as f:
                for line in f:
                    key, eq, value = line.strip().partition("=")
                    if eq and key and not key.startswith("#"):
                        out.setdefault(key.strip(), value.strip().strip("\"'"))
    told = {k: v for k, v in json_settings(json_files or []).items() if isinstance(v, str) and v}
    return told | out | dict(os.environ if environment is None else environment)
