"""Exports: text, Markdown, HTML, CSV, JSON by Spark's writers; a keyed document store. DOCX and PDF have modules of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.exports import text_parts

FORMATS = ["txt", "md", "html", "csv", "json"]


def _escaped(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def rendered(rows: DataFrame, key: str, order: str, mode: str, fmt: str) -> DataFrame:
    """(key, content) of each document in txt, md or html; rows (key, order, kind, source, translation)."""
    parts = rows.select(key, order, "kind", F.posexplode(text_parts(F.col("source"), F.col("translation"), mode)).alias("_n", "_p"))
    t = F.col("_p.text")
    if fmt == "md":
        t = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), t)).when(F.col("kind") == "list-item", F.concat(F.lit("- "), t)).otherwise(t)
    elif fmt == "html":
        tag = F.when(F.col("kind") == "heading", "h2").when(F.col("kind") == "list-item", "li").otherwise("p")
        t = F.concat(F.lit("<"), tag, F.lit(">"), _escaped(t), F.lit("</"), tag, F.lit(">"))
    held = parts.select(key, order, "_n", t.alias("_t")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "_n", "_t"))).alias("_a"))
    return held.select(key, F.array_join(F.col("_a._t"), "\n" if fmt == "html" else "\n\n").alias("content"))


def write(rows: DataFrame, path: str, key: str, order: str, mode: str = "parallel", fmt: str = "txt") -> None:
    """Write rows (key, order, kind, source, translation): csv and json as rows, else a file per document in a folder
    named by its key."""
    if fmt not in FORMATS:
        raise ValueError(f"no writer for {fmt}")
    if fmt in ("csv", "json"):
        flat = rows.select(key, order, "kind", F.posexplode(text_parts(F.col("source"), F.col("translation"), mode)).alias("part", "_p")).select(key, order, "kind", "part", "_p.text", "_p.translated")
        (flat.write.option("header", "true").option("escape", '"').csv(path) if fmt == "csv" else flat.write.json(path))
    else:
        rendered(rows, key, order, mode, fmt).select(key, "content").write.partitionBy(key).text(path)


def latest(rows: DataFrame) -> DataFrame:
    """(id, ...) of the last version of each id in rows (id, _version, _deleted, ...), if that isn't a deletion.

    Of rows of one version a hash of their fields decides, so every read sees the same one.
    """
    fields = [c for c in rows.columns if c not in ("id", "_version", "_deleted")]
    place = F.struct("_version", F.xxhash64(F.to_json(F.struct("_deleted", *fields))))
    last = rows.groupBy("id").agg(F.max_by(F.struct("_deleted", *fields), place).alias("_r"))
    return last.where("not _r._deleted").select("id", *(F.col(f"_r.{c}").alias(c) for c in fields))


class DocumentStore:
    """Documents keyed by id in Parquet: every put or delete appends a version, reads take the last of each id."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def next_version(self) -> int:
        """One more than the greatest version so far; for a single writer at a time."""
        try:
            return (self.spark.read.parquet(self.path).agg(F.max("_version")).first()[0] or 0) + 1
        except AnalysisException:
            return 1

    def put(self, docs: DataFrame, version: int | None = None) -> None:
        """docs (id, ...) as of a version that is greater than all before it."""
        version = self.next_version() if version is None else version
        docs.withColumns({"_version": F.lit(version).cast("long"), "_deleted": F.lit(False)}).write.mode("append").parquet(self.path)

    def delete(self, ids: DataFrame, version: int | None = None) -> None:
        version = self.next_version() if version is None else version
        ids.select("id").withColumns({"_version": F.lit(version).cast("long"), "_deleted": F.lit(True)}).write.mode("append").parquet(self.path)

    def all(self) -> DataFrame:
        try:
            rows = self.spark.read.option("mergeSchema", "true").parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], "id string")
        return latest(rows)

    def get(self, ident) -> DataFrame:
        return self.all().where(F.col("id") == ident)

    def set_meta(self, key: str, value: str) -> None:
        """Keep a value under a name, beside the documents."""
        DocumentStore(self.spark, f"{self.path.rstrip('/')}-meta").put(self.spark.createDataFrame([(key, value)], "id string, value string"))

    def get_meta(self, key: str) -> str | None:
        held = DocumentStore(self.spark, f"{self.path.rstrip('/')}-meta").get(key)
        row = held.first()
        return row["value"] if row else None
