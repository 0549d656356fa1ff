"""Translation runs as streams: results are appended batch by batch, so a run that is stopped keeps what is done.

The units of a run lie in a folder as Parquet; each batch takes some of its files, calls the translator and appends the
results. stop() of the query is a cancel: units of the batch under way are called again when the run goes on, all others
are not, and the results hold each unit once, as the sink keeps a log of its batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import dispatch, runlog

UNIT = "doc_id long, id string, text string, start_ms long"


def put_units(units: DataFrame, folder: str, files: int) -> None:
    """Add units (doc_id, id, text and perhaps start_ms) to a run, in so many files; batches are made of whole files."""
    start = F.col("start_ms").cast("long") if "start_ms" in units.columns else F.lit(None).cast("long").alias("start_ms")
    units.select(F.col("doc_id").cast("long"), F.col("id").cast("string"), "text", start).repartition(files, "doc_id", "id").write.mode("append").parquet(folder)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, translator: dispatch.Translator, files_per_batch: int = 1, granted: bool = False, **limits) -> StreamingQuery:
    """Translate the units of a folder that have no result yet, as Parquet (dispatch.RESULT) under out.

    granted: units have a start_ms and wait for it; else limits are those of dispatch.translate().
    """
    units = spark.readStream.schema(UNIT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    done = dispatch.translate(units if granted else units.drop("start_ms"), translator, **limits)
    return done.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def results(spark: SparkSession, out: str) -> DataFrame:
    """The results that are there so far."""
    return spark.read.schema(dispatch.RESULT).parquet(out)


def events(spark: SparkSession, folder: str, out: str, about: DataFrame, rpm_used: int = 0) -> DataFrame:
    """runlog.run_events() of a run so far: about is a row (run_id, max_rpm, max_concurrency, model, provider, retries,
    error), error null unless the run broke off. Units settle in the order of document and id."""
    n = spark.read.schema(UNIT).parquet(folder).count()
    run = about.first()
    r = results(spark, out).withColumns({c: F.lit(run[c]) for c in ("run_id", "retries")})
    r = r.select("run_id", F.struct("doc_id", "id").alias("seq"), "id", "ok", "attempts", "retries", F.col("error").alias("message"), "translation", F.lit(rpm_used).alias("rpm_used"))
    return runlog.run_events(r, about.drop("retries").withColumns({"units": F.lit(n).cast("long"), "paragraphs": F.lit(n).cast("long")}))
