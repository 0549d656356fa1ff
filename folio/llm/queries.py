"""The registered queries of the training-data operators, each over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chains, chat, infill, media, neighbours, packing, pieces, quality, separators, simhash, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.repeated_passages(_table(spark, sf_dir, "documents"))


def op4_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.count_documents(_table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list is the URLs of pages whose id is divisible by 20."""
    pages = _table(spark, sf_dir, "pages")
    return urls.judge(pages, pages.where("page_id % 20 = 0"), urls.RULES)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(*chat.from_conversations(_table(spark, sf_dir, "conversations")), chat.SCHEMAS)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_table(spark, sf_dir, "documents"))


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(pieces.encode(_table(spark, sf_dir, "documents")))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.transform(_table(spark, sf_dir, "documents"), seed=1, plain=10, spm=20))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 is asked for its 20 nearest among all others."""
    index = neighbours.build(_table(spark, sf_dir, "embeddings"))
    return neighbours.search(index, index.where("vec_id % 20 = 0"), k=20)


QUERIES = {f.__name__: f for f in (op1_quality, op2_packing, op3_passages, op4_separators, op5_simhash, op6_urls, op7_warc, op8_chat, op9_media, op10_pieces, op11_infill, op12_neighbours)}
ORACLE_SQL: dict[str, str] = {"op1_quality": quality.ORACLE, "op6_urls": urls.ORACLE, "op7_warc": warc.ORACLE, "op8_chat": chat.ORACLE, "op11_infill": infill.ORACLE, "op12_neighbours": neighbours.ORACLE}
