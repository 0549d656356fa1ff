"""Provider records: the list, lookup with a default, additions and removals. Keys are never part of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import js, text

NAME, MODEL = 40, 160  # characters kept
STYLES = ["openai", "anthropic", "gemini", "unsupported"]


def listed(builtin: DataFrame, custom: DataFrame) -> DataFrame:
    """Built-in records, then custom ones that have an id and an address."""
    ok = (F.coalesce("id", F.lit("")) != "") & (F.coalesce("base_url", F.lit("")) != "")
    return builtin.withColumn("custom", F.lit(False)).unionByName(custom.where(ok).withColumn("custom", F.lit(True)))


def resolve(requests: DataFrame, providers: DataFrame, default: str) -> DataFrame:
    """requests (request_id, provider_id) with the record of each: a custom one before a built-in one, else the default."""
    best = providers.groupBy("id").agg(F.max_by(F.struct("name", "base_url", "model", "custom"), F.col("custom").cast("int")).alias("p"))
    known = best.select(F.col("id").alias("provider_id"), "p")
    found = requests.join(known.select("provider_id", F.lit(True).alias("_found")), "provider_id", "left")
    meant = found.withColumn("provider_id", F.when(F.col("_found"), F.col("provider_id")).otherwise(F.lit(default)))
    return meant.join(known, "provider_id", "left").select("request_id", "provider_id", "p.*")


def upsert(custom: DataFrame, new: DataFrame) -> DataFrame:
    """Custom records with new ones in the place of those of the same id."""
    return custom.join(new.select("id"), "id", "left_anti").unionByName(new)


def remove(custom: DataFrame, ids: DataFrame) -> DataFrame:
    return custom.join(ids.select("id"), "id", "left_anti")


def normalized(custom: DataFrame) -> DataFrame:
    """custom (id, name, base_url, model) with names cut, addresses without a last slash, and valid: whether a name, a
    model and an address of http or https are there."""
    address = F.regexp_replace(js.trim(js.text(F.col("base_url"))), r"/\z", "")
    out = custom.withColumns({"name": text.cut(F.col("name"), NAME), "model": text.cut(F.col("model"), MODEL), "base_url": address})
    valid = (F.col("name") != "") & (F.col("model") != "") & js.test(F.col("base_url"), r"(?i)\Ahttps?://[^/?#\s]+[^\s]*\z")
    return out.withColumn("valid", valid)
