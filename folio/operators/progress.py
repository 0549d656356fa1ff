"""Progress of documents and runs, request rates, retry delays."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import js

WINDOW_MS, SLACK_MS = 60_000, 30


def percent(done: Column, total: Column) -> Column:
    return F.when(total > 0, js.half_up(100 * done / total)).otherwise(F.lit(0).cast("long"))


def document_progress(units: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, completed, total, percent, complete) of units (key, id, translation, status); a null id is no unit."""
    done = F.col("id").isNotNull() & (js.text(F.col("translation")) != "") & (F.col("status") == "done")
    agg = units.groupBy(key).agg(F.sum(F.when(done, 1).otherwise(0)).cast("long").alias("completed"), F.count("id").alias("total"))
    return agg.select(key, "completed", "total", percent(F.col("completed"), F.col("total")).alias("percent"), ((F.col("total") > 0) & (F.col("completed") == F.col("total"))).alias("complete"))


def pending(progress: DataFrame) -> DataFrame:
    return progress.where("not complete")


def unfinished(units: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Units without a result, for a run that goes on."""
    return units.join(done.select(*keys).distinct(), keys, "left_anti")


def run_progress(results: DataFrame, run: str = "run_id", order: str = "seq") -> DataFrame:
    """results (run, order, ok boolean) with completed, failed, settled, units and percent after each."""
    w = Window.partitionBy(run)
    upto = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c, over: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(over), F.lit(0)).cast("long")
    out = results.withColumns({"completed": count(F.col("ok"), upto), "failed": count(~F.col("ok"), upto), "units": F.count("*").over(w)})
    return out.withColumn("settled", F.col("completed") + F.col("failed")).withColumn("percent", percent(F.col("settled"), F.col("units")))


def run_totals(results: DataFrame, run: str = "run_id", ident: str | None = None, order: str = "seq") -> DataFrame:
    """(run, completed, failed, settled), and with ident failed_ids, the units that failed in order."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    lost = [F.transform(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct(order, ident)))), lambda x: x[ident]).alias("failed_ids")] if ident else []
    return results.groupBy(run).agg(n(F.col("ok")).alias("completed"), n(~F.col("ok")).alias("failed"), F.count("*").alias("settled"), *lost)


def recent_requests(events: DataFrame, key: str, ms: str = "ms", ident: str = "event_id") -> DataFrame:
    """events with in_window: how many of the key began in the 60 s up to and with each (its start excluded).

    Time is cut into stretches of 60 s. A request counts in its own stretch from its time on, and in the next one until
    it is 60 s old, so each stretch is counted by itself by a running sum, however many requests a key has.
    """
    at = F.col(ms).cast("long")
    stretch = at - F.pmod(at, F.lit(WINDOW_MS))
    row = F.struct(*(F.col(f"`{c}`") for c in events.columns))
    begins = F.struct(stretch.alias("of"), at.alias("at"), F.lit(1).alias("n"), row.alias("row"))
    ends = F.struct((stretch + WINDOW_MS).alias("of"), (at + WINDOW_MS).alias("at"), F.lit(-1).alias("n"), F.lit(None).cast(events.select(row).schema[0].dataType).alias("row"))
    both = events.select(F.col(key).alias("_key"), F.explode(F.array(begins, ends)).alias("_e")).select("_key", "_e.*")
    w = Window.partitionBy("_key", "of")
    upto = w.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("in_window", F.sum("n").over(upto) + F.sum(F.when(F.col("n") < 0, 1).otherwise(0)).over(w))
    return counted.where("n > 0").select("row.*", "in_window")


def listed_starts(starts: DataFrame, marks: DataFrame, key: str, ms: str = "ms") -> DataFrame:
    """marks (key, ms, ...) with listed: how many starts a limiter's list holds then.

    The list is cleared of old starts only when the next one is added, so it has those of the 60 s up to the last start.
    """
    s = recent_requests(starts.select(key, ms), key, ms).select(key, ms, F.col("in_window").alias("_n"), F.lit(0).alias("_mark"), F.lit(None).cast(marks.select(F.struct("*")).schema[0].dataType).alias("_row"))
    m = marks.select(key, ms, F.lit(None).cast("long").alias("_n"), F.lit(1).alias("_mark"), F.struct("*").alias("_row"))
    upto = Window.partitionBy(key).orderBy(ms, "_mark").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(m).withColumn("listed", F.coalesce(F.last("_n", ignorenulls=True).over(upto), F.lit(0).cast("long")))
    return both.where("_mark = 1").select("_row.*", "listed")


def admissions(events: DataFrame, key: str, rpm: int, ms: str = "ms", ident: str = "event_id") -> DataFrame:
    """(key, ident, ms, start): when a sliding-log limiter lets each request of a key begin, first come first served.

    A request waits for the one rpm places before it to be 60 s old (then 30 ms more), if it isn't when it comes. Each
    start depends on the one before, so a key is one run of sorted rows; a task goes through it batch by batch and holds
    no more than the last rpm starts.
    """
    rows = events.select(key, ident, ms)
    names = [key, ident, ms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: object = run
        log: deque[int] = deque(maxlen=rpm)
        now = 0
        for b in batches:
            out = []
            for k, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k != held:
                    held, now = k, t
                    log.clear()
                now = max(t, now)
                if len(log) == rpm and log[0] > now - WINDOW_MS:
                    now = log[0] + WINDOW_MS + SLACK_MS
                log.append(now)
                out.append(now)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], [*names, "start"])

    rows = rows.withColumn(ms, F.col(ms).cast("long")) if rows.schema[ms].dataType.simpleString() != "bigint" else rows
    fields = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.repartition(key).sortWithinPartitions(key, ms, ident).mapInArrow(run, f"{fields}, start long")


def retry_delay(attempt: Column) -> Column:
    """Milliseconds before the attempt after this one (counted from 0)."""
    return F.least(F.lit(8000.0), 1500 * F.pow(F.lit(2.0), attempt)).cast("long")
