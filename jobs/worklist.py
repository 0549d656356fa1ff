"""Batch job: the work list of a corpus translation. Each distinct text is to be sent once, however often it stands.

    python -m jobs.worklist --documents DIR --output DIR [--done DIR] [--config FILE]

Reads Parquet documents (doc_id, text, lang). Their lines are cleaned, page furniture and lines without language are left
out, long ones are cut, and equal texts of a language become one unit with the number of its uses, its first place and the
request to send. --done names Parquet files with (lang, text_id) of units that have their translation already.

Writes Parquet (SCHEMA), partitioned by lang. With `languages` in the configuration only those are read, and only their
partitions are replaced; else the whole output is. The result depends on nothing but input and configuration, so a run
that broke off, or runs again, leaves the same rows.

Equal texts are counted before the shuffle, so a line that stands in every document is one row per task there. A null text
has no lines; a null language is a partition of its own; a null doc_id comes first as a place.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folio.functions import text
from folio.operators import blocks, segment, wire
from jobs import _common

SCHEMA = "text_id string, text string, n_chars long, uses long, doc_id long, ord long, url string, body string, error string, lang string"
log = logging.getLogger("jobs.worklist")


def units(documents: DataFrame, limit: int) -> DataFrame:
    """(lang, text_id, text, n_chars, uses, doc_id, ord) of each distinct text; ord: the line, from 1."""
    # cleaned before the lines become rows: the rules below would each clean a column again
    lines = documents.select("doc_id", "lang", F.posexplode(F.transform(F.split("text", "\n"), text.normalize_extracted)).alias("seq", "text"))
    told = lines.where((F.col("text") != "") & ~blocks.furniture(F.col("text")) & segment.translatable(F.col("text")))
    pieces = told.select("doc_id", "lang", (F.col("seq") + 1).cast("long").alias("ord"), F.explode(segment.long_text(F.col("text"), limit)).alias("text"))
    one = pieces.groupBy("lang", "text").agg(F.count("*").alias("uses"), F.min(F.struct("doc_id", "ord")).alias("at"))
    return one.select("lang", F.sha2(F.col("text").cast("binary"), 256).alias("text_id"), "text", F.length("text").cast("long").alias("n_chars"), "uses", "at.doc_id", "at.ord")


def run(spark: SparkSession, documents: str, output: str, config: dict, done: str | None = None) -> None:
    """The work list of the documents at one path, written to another."""
    read = Observation("read")
    docs = spark.read.parquet(documents).select(F.col("doc_id").cast("long"), "text", "lang")
    if config["languages"] is not None:
        docs = docs.where(F.col("lang").isin(config["languages"]))
    docs = docs.observe(read, F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"))
    todo = units(docs, config["limit"])
    if done:
        known = spark.read.parquet(done).select(F.col("lang").alias("_lang"), F.col("text_id").alias("_id"))
        todo = todo.join(known, todo["lang"].eqNullSafe(known["_lang"]) & (todo["text_id"] == known["_id"]), "left_anti")
    lit = {k: F.lit(config[k]) for k in ("style", "base_url", "model", "effort", "system", "target")}
    unit = F.array(F.struct(F.col("text_id").alias("id"), "text"))
    request = wire.request(lit["style"], lit["base_url"], lit["model"], lit["effort"], lit["system"], F.coalesce("lang", F.lit("")), lit["target"], unit)
    rows = todo.withColumn("r", request).select("text_id", "text", "n_chars", "uses", "doc_id", "ord", "r.url", "r.body", "r.error", "lang")
    mode = "static" if config["languages"] is None else "dynamic"
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("lang").parquet(output)
    log.info("read %s documents of %s characters from %s", read.get["documents"], read.get["characters"] or 0, documents)
    for r in spark.read.schema(SCHEMA).parquet(output).groupBy("lang").agg(F.count("*").alias("n"), F.sum("uses").alias("uses")).collect():  # a row per language
        log.info("%s holds %s units for %s places in language %s", output, r["n"], r["uses"], r["lang"])


def result(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(output)


def main() -> None:
    a = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("--documents", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--done")
    a.add_argument("--config")
    a = a.parse_args()
    spark = _common.session("worklist")
    try:
        run(spark, a.documents, a.output, _common.config("worklist", a.config), a.done)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
