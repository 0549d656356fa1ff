"""Token counts of flat token files: a vectorised separator scan, stitched across blocks by a prefix scan.

The files hold nothing but ids of a fixed width, each document followed by an end-of-document id. Blocks of a file are
read by range, wherever they begin, and compared with the separator as whole arrays. What a block can't know (how many
separators stand before it, and where the last of them is) comes from a prefix scan over one row per block: a running
count and a running maximum in a window per file.

Defined cases: a null text counts as empty, a document of no ids; ids after the last separator are a last document that
isn't ended; repeated rows are documents each; further columns are ignored; empty tables and files give no rows; a
file whose length isn't a multiple of the id width raises ValueError.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._files import open_folder, task_name
from ._shared import materialise, only, scratch_path, small_batches
from .tokens import vocabulary

BLOCK = 4_000_000  # bytes
END = 50256


@functools.lru_cache(maxsize=2)
def _byte_bpe(name: str):
    import public_tokenizers
    import tiktoken

    with open(vocabulary(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.tiktoken", end: int = END, width: int = 2) -> DataFrame:
    """Write ids of each text and the end id to flat files under folder; (file, ordinal, doc_id) of the documents.

    A task writes one file. A failed attempt leaves a file that no row names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        encode = _byte_bpe(tokenizer).encode_ordinary
        name, out, n = f"tokens-{task_name()}.bin", None, 0
        try:
            for b in small_batches(batches, "text"):
                out = out or fs.open_output_stream(f"{root}/{name}")
                for t in b.column("text").to_pylist():
                    out.write(np.array([*(encode(t) if t else ()), end], f"<u{width}").tobytes())
                k = b.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array(np.arange(n, n + k)), b.column("doc_id")], ["file", "ordinal", "doc_id"])
                n += k
        finally:
            if out is not None:
                out.close()

    docs = only(docs, "doc_id", "text")
    return docs.mapInArrow(run, f"file string, ordinal long, doc_id {docs.schema['doc_id'].dataType.simpleString()}")


def separators(spark: SparkSession, folder: str, files: DataFrame, end: int = END, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, i, at, before): each separator's number in its block, its place and the one before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for b in batches:
            for name, k, length in zip(*(b.column(c).to_pylist() for c in ("file", "block", "length")), strict=True):
                if length % width:
                    raise ValueError(f"{name} has {length} bytes")
                start = k * block
                with fs.open_input_file(f"{root}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(block, length - start), start), f"<u{width}")
                at = np.flatnonzero(ids == end) + start // width
                if len(at):
                    before = pa.array(np.append(0, at[:-1]), mask=np.arange(len(at)) == 0)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), k)), pa.array(np.arange(len(at))), pa.array(at), before], ["file", "block", "i", "at", "before"])

    blocks = files.where("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block"))
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return blocks.repartition(n, "file", "block").mapInArrow(run, "file string, block long, i long, at long, before long")


def counts(spark: SparkSession, folder: str, end: int = END, width: int = 2, block: int = BLOCK, named: DataFrame | None = None) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of each document of the files under folder.

    named: (file), if only these count; tasks that failed may have left others, whole or cut anywhere.
    """
    if block % width:
        raise ValueError("a block has to hold whole ids")
    listed = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    if named is not None:
        listed = listed.join(named.select("file").distinct(), "file", "left_semi")
    files = materialise(listed, "files")
    found = materialise(separators(spark, folder, files, end, width, block), "separators")
    per_block = found.groupBy("file", "block").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = per_block.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("seen"), F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carry"))
    scan = materialise(scan, "scan")
    first = F.coalesce(F.col("before"), F.col("carry")) + 1
    docs = found.join(scan, ["file", "block"]).select("file", (F.col("seen") + F.col("i")).alias("ordinal"), first.alias("start"), (F.col("at") - first).alias("n_tokens"), F.lit(True).alias("ended"))
    total = per_block.groupBy("file").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    tail = files.join(total, "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), F.floor(F.col("length") / width).alias("ids"))
    return docs.unionByName(tail.where("ids > start").select("file", "ordinal", "start", (F.col("ids") - F.col("start")).alias("n_tokens"), F.lit(False).alias("ended")))


def count_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens) of each text, written to flat files in the shared folder and counted from those."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "tokens")
    names = materialise(write(docs, folder), "names")
    if names.isEmpty():
        return names.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    return names.join(counts(spark, folder, named=names), ["file", "ordinal"]).select("doc_id", "n_tokens")
