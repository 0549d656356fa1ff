"""Raw documents to packed training sequences: quality rules, near-dedup, substring dedup, packing.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; run() writes each result as Parquet in the
shared folder and reads it back as the next stage's docs. A run deletes what its stages left once their results are
written, and touches nothing of other runs; the last stage's result is lazy, and its tables stay. No stage can be put in
SQL whole: the fences are quantile sketches, and MinHash bands, chaining and best-fit packing are iterative.
tests/llm/test_pipeline.py checks the stages against brute force on a whole table, and on planted cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import chains, packing, quality, simhash
from folio.llm._shared import drop_scratch, materialise, scratch

def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source."""
    return quality.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (least doc_id) of each group alike in five-word shingles at 0.8 or more."""
    return simhash.drop_near_duplicates(docs, similarity=0.8)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document holds."""
    return chains.cut_passages(docs, min_words=50)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: a row per piece with its sequence and its place there."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = docs
        with scratch(spark):
            docs = materialise(stage(spark, before, sf_dir), name.replace(" ", "-"), outlives=True, codec="zstd")
        drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
