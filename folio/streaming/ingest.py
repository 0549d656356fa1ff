"""Files taken up as they come, and run events as a stream. Checkpoints make both take each input once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.segment import split_paragraphs
from ..sources import files as sources

FILE = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    """A stream of (path, name, ext, length, content) of supported files that appear in a folder."""
    f = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).option("recursiveFileLookup", "true").load(folder)
    f = f.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(sources.supported(F.col("name")))
    return f.select("path", "name", F.lower(F.substring_index("name", ".", -1)).alias("ext"), "length", "content")


def ingest(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Paragraphs (path, ord, id, text) of new files as Parquet under out, in one pass over what is there."""

    def batch(df: DataFrame, epoch: int) -> None:
        texts = sources.extract_text(df).where("text is not null")
        parts = texts.select("path", F.posexplode(split_paragraphs(F.col("text"))).alias("ord", "text"))
        # a batch that is run again writes its own folder again
        parts.select("path", (F.col("ord") + 1).alias("ord"), F.concat(F.lit("p-"), F.col("ord") + 1).alias("id"), "text").write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return new_files(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def events(results: DataFrame) -> DataFrame:
    """(run_id, seq, event, payload) of unit results (run_id, seq, id, ok, text): a paragraph or unit-error each."""
    payload = F.to_json(F.struct("id", F.when(F.col("ok"), F.col("text")).alias("translation"), F.when(~F.col("ok"), F.col("text")).alias("message")))
    return results.select("run_id", "seq", F.when(F.col("ok"), "paragraph").otherwise("unit-error").alias("event"), payload.alias("payload"))
