"""Rows, blocks and files for export in three modes: source, translation, both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js

MODES = ["source", "translation", "parallel"]
ROW_LIMIT, TEXT_LIMIT, CONTENT_LIMIT = 10_000, 100_000, 200_000


def export_rows(rows: DataFrame, export: list[str], order: list[str]) -> DataFrame:
    """The first ROW_LIMIT rows of each export (the engine's limit on one), cut to the text limits, then those with any text."""
    cut = lambda c, n: F.substring(js.text(F.col(c)), 1, n).alias(c)
    place = F.row_number().over(Window.partitionBy(*export).orderBy(*order))
    first = rows.withColumn("_place", place).where(F.col("_place") <= ROW_LIMIT)
    kind = F.when(F.col("type") == "table-cell", "table-cell").otherwise("paragraph")
    out = first.select(*export, *order, kind.alias("type"), cut("source", TEXT_LIMIT), cut("translation", TEXT_LIMIT), cut("content", CONTENT_LIMIT))
    return out.where("source != '' or translation != '' or content != ''")


def text_parts(source: Column, translation: Column, mode: str) -> Column:
    """array<text, translated> of what a mode shows of a pair."""
    source, translation = js.text(source), js.text(translation)
    part = lambda t, translated: F.struct(t.alias("text"), translated.alias("translated"))
    src = part(source, F.lit(False))
    if mode == "source":
        parts = F.array(src)
    elif mode == "translation":
        some = translation != ""
        parts = F.array(part(F.when(some, translation).otherwise(source), some))
    else:
        parts = F.array(src, part(translation, F.lit(True)))
    return F.filter(parts, lambda p: p["text"] != "")


def row_parts(source: Column, translation: Column, content: Column, mode: str) -> Column:
    """array of the texts of a row, its content where it has none of those."""
    some = lambda *cs: F.filter(F.array(*cs), lambda t: t != "")
    first = lambda a: F.coalesce(js.truthy(js.text(a)), js.text(content))
    if mode in ("source", "translation"):
        return some(first(source if mode == "source" else translation))
    both = some(js.text(source), js.text(translation))
    return js.bind(both, lambda b: F.when(F.size(b) > 0, b).otherwise(some(js.text(content))))


def with_paragraphs(blocks: DataFrame, paragraphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """blocks (keys, text) with source, translation and kind of their paragraph, the last one of a repeated id.

    A block without one, or with an empty one, shows its own text.
    """
    last = paragraphs.groupBy(*keys).agg(F.max_by(F.struct("source", "translation", "kind"), order).alias("_p"))
    own = F.coalesce(js.truthy(F.col("_p.source")), js.text(F.col("text")))
    return blocks.join(last, keys, "left").select(*blocks.columns, own.alias("source"), js.text(F.col("_p.translation")).alias("translation"), F.coalesce(js.truthy(F.col("_p.kind")), F.lit("paragraph")).alias("kind"))


def with_assets(blocks: DataFrame, assets: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, latex) with mime_type and data of their asset; those with neither asset nor LaTeX are dropped."""
    held = assets.where("data is not null").dropDuplicates(keys).select(*keys, "mime_type", "data")
    return blocks.join(held, keys, "left").where(F.col("data").isNotNull() | (js.text(F.col("latex")) != ""))


def document_text(parts: DataFrame, key: str, order: str, content: str = "text", separator: str = "\n\n") -> DataFrame:
    """(key, text) of each document, its parts in order."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, content))).alias("_p"))
    return rows.select(key, F.array_join(F.filter(F.col(f"_p.{content}"), lambda t: t != ""), separator).alias("text"))
