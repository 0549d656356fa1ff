"""Incremental job: paragraphs of pages as they arrive, and which of them a site has not shown before.

    python -m jobs.inbox --pages DIR --output DIR --checkpoint DIR [--config FILE]

A file stream over Parquet pages (page_id, url, html) takes the files that came since the last run, at most `max_files` a
batch, and ends when none is left; its checkpoint is the mark. Pages become text and paragraphs; a paragraph is new if its
host has not had it in an earlier batch, nor at an earlier place (page_id, then number) of this one. Only new ones carry
their text, so crawling a site again, menus and footers cost one translation a site.

Writes Parquet (SCHEMA), partitioned by batch. A batch looks at the output of earlier batches only and overwrites its own
partition, so one that is run again, after whatever failure, leaves the same rows. The output is thus kept by one stream.

First places come from an aggregate, known paragraphs go by an anti-join on (host, text_id), and the mark goes back to its
place by a join on the whole place, so no key gathers the rows of a site. Of a page that comes twice in a batch with the
same text one row per paragraph is kept. A null html has no paragraphs; a null url, or one without `://`, has the empty host.
"""

from __future__ import annotations

import argparse
import logging

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import segment
from jobs import _common

PAGE = "page_id long, url string, html string"
SCHEMA = "page_id long, ord long, host string, text_id string, n_chars long, is_new boolean, text string, batch long"
PLACE = ["page_id", "ord", "host", "text_id"]
log = logging.getLogger("jobs.inbox")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, ord, host, text_id, n_chars, text) of the paragraphs that hold language."""
    p = pages.select("page_id", host(F.col("url")).alias("host"), F.posexplode(segment.split_paragraphs(text.strip_html(F.col("html")))).alias("ord", "text"))
    p = p.where(segment.translatable(F.col("text")))
    p = p.select("page_id", (F.col("ord") + 1).cast("long").alias("ord"), "host", F.sha2(F.col("text").cast("binary"), 256).alias("text_id"), F.length("text").cast("long").alias("n_chars"), "text")
    return p.dropDuplicates(PLACE)


def take(pages: DataFrame, output: str, batch: int) -> None:
    """One batch of pages, written as its partition of the output."""
    spark = pages.sparkSession
    found = paragraphs(pages).persist(StorageLevel.DISK_ONLY)
    try:
        first = found.groupBy("host", "text_id").agg(F.min(F.struct("page_id", "ord")).alias("at"))
        known = result(spark, output).where(F.col("is_new") & (F.col("batch") < batch)).select("host", "text_id")
        new = first.join(known, ["host", "text_id"], "left_anti").select("host", "text_id", F.col("at.page_id").alias("_page"), F.col("at.ord").alias("ord"), F.lit(True).alias("_new"))
        rows = found.join(new, ["host", "text_id", "ord"], "left").withColumn("is_new", F.coalesce(F.col("_new") & F.col("page_id").eqNullSafe(F.col("_page")), F.lit(False)))
        rows = rows.select(*PLACE, "n_chars", "is_new", F.when(F.col("is_new"), F.col("text")).alias("text"), F.lit(batch).cast("long").alias("batch"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(output)
    finally:
        found.unpersist()
    n = result(spark, output).where(F.col("batch") == batch).agg(F.count("*").alias("n"), F.count_if("is_new").alias("new"), F.count_distinct("page_id").alias("pages")).first()
    log.info("batch %s: %s pages gave %s paragraphs, %s of them new, written to %s", batch, n["pages"], n["n"], n["new"], output)


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def run(spark: SparkSession, pages: str, output: str, checkpoint: str, config: dict) -> None:
    """Take what is new at pages (a folder, or a pattern of files), and end."""
    spark.createDataFrame([], SCHEMA).write.mode("append").partitionBy("batch").parquet(output)  # so that there is a folder
    stream = spark.readStream.schema(PAGE).option("maxFilesPerTrigger", config["max_files"]).parquet(pages)
    query = stream.writeStream.foreachBatch(lambda df, n: take(df, output, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %s new pages from %s", rows, pages)


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("--pages", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--checkpoint", required=True)
    a.add_argument("--config")
    a = a.parse_args()
    spark = _common.session("inbox")
    try:
        run(spark, a.pages, a.output, a.checkpoint, _common.config("inbox", a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
