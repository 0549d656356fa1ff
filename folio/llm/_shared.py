"""Scratch tables in the shared folder, and helpers for Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_SHUFFLE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. One of our own is made only in local mode, where all is one machine's."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="folio-"))
    return sc.getCheckpointDir()


_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Deletes, when the block ends, the tables that operators called in it left in the shared folder.

    Results of operators are lazy and read such tables, so write them inside the block. Blocks are of a thread and may
    be nested; outside of any, tables stay, as those of checkpoint() do.
    """
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield paths
    finally:
        _scopes.reset(token)
        for p in paths:
            _delete(spark, p)


def scratch_path(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """A new path in the shared folder. outlives: it belongs to the block around the innermost one."""
    path = f"{shared_dir(spark).rstrip('/')}/folio/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()
    if scopes := scopes[:-1] if outlives else scopes:
        scopes[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialise(df: DataFrame, name: str, by: str | None = None, outlives: bool = False, codec: str | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, which cuts its lineage.

    by: a column of a few values, each of which gets a folder of its own, so that drop_scratch() can delete it by itself.
    outlives: as in scratch_path(). codec: of the files, if not the session's; zstd pays for texts, not for hashes.
    Shuffle files of the finished job are dropped at once where Spark offers that, and Arrow batches are kept small, as
    rows may hold whole texts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name, outlives)
    own = {CLEAN_SHUFFLE: "true", BATCH_ROWS: "1000", WRITERS: "8"}
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        writer = df.write.partitionBy(by) if by else df.write
        (writer.option("compression", codec) if codec else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_scratch(*tables: DataFrame, of: str = "") -> None:
    """Delete tables made by materialise() that no later plan reads; of: only the folder of one value, as "part=0"."""
    for df in tables:
        if path := getattr(df, "_scratch_path", None):
            _delete(df.sparkSession, f"{path}/{of}" if of else path)


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, written as a table, with _rank: the place of each row in the order of some columns, from 0 without a gap.

    A range sort and the sizes of its partitions; no task sees more than its partition, however the keys are spread.
    """
    spark = df.sparkSession
    n = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    held = materialise(held, name)
    part, place = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(held.groupBy(part.alias("part")).agg((F.max(place) + 1).alias("n")).collect())  # a row per partition
    starts, at = [], 0
    for r in sizes:
        starts.append((r["part"], at))
        at += r["n"]
    starts = spark.createDataFrame(starts, "_part long, _start long")
    return held.join(F.broadcast(starts), part == F.col("_part")).withColumn("_rank", F.col("_start") + place).drop("_id", "_part", "_start")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, so that further columns of the input can't clash with ours."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def give_back() -> None:
    """Return freed memory of this Python worker to the system, as it idles between tasks of other kinds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose `column` holds about `limit` bytes, or one row where that alone is longer."""
    for batch in batches:
        col = batch.column(column)
        if batch.num_rows == 0:
            continue
        ends = np.cumsum([0 if x is None else x for x in pc.binary_length(col).to_pylist()])
        at, base = 0, 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, stop - at)
            at, base = stop, int(ends[stop - 1])
    give_back()


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the row where each group starts (and the end).

    The rows have to come sorted by keys. A group that goes over several batches is joined once.
    """
    held: list[pa.RecordBatch] = []

    def starts(t) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k)
            c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
            v = c.to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        at = starts(batch)
        first = batch.slice(0, 1)
        same = bool(held) and all(held[-1].column(k)[held[-1].num_rows - 1].as_py() == first.column(k)[0].as_py() for k in keys)
        if same and len(at) == 1:
            held.append(batch)
            continue
        cut = int(at[-1])
        whole = [*held, batch.slice(0, cut)] if cut else held
        if whole:
            t = pa.Table.from_batches(whole).combine_chunks()
            yield t, np.append(starts(t), t.num_rows)
        held = [batch.slice(cut)]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, np.append(starts(t), t.num_rows)
    give_back()
