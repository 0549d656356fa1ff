"""The events of translation runs, made from the results of their units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import progress


def run_events(results: DataFrame, runs: DataFrame) -> DataFrame:
    """(run_id, n, event, payload) of each run: meta, then per unit unit-start, unit-retry of each new attempt,
    paragraph or unit-error, and progress; last done, or error with the run's message if it broke off.

    results (run_id, seq, id, ok, attempts, retries, message, translation, rpm_used), units settled in order of seq by
    one worker; runs (run_id, max_rpm, max_concurrency, model, provider, paragraphs), and if they have them units (asked
    for, also those that were not settled; else the settled ones) and error. A run without units has its meta and done.
    Results of runs that aren't there have no events. Windows are per run.
    """
    whole = Window.partitionBy("run_id")
    upto = whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(upto)
    totals = progress.run_totals(results, ident="id")
    no_ids = F.array().cast("array<string>")
    asked = F.col("units") if "units" in runs.columns else F.lit(None).cast("long")
    error = F.col("error") if "error" in runs.columns else F.lit(None).cast("string")
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    both = runs.withColumns({"units": asked, "error": error}).join(totals, "run_id", "left")
    both = both.select("run_id", "max_rpm", "max_concurrency", "model", "provider", "paragraphs", "error", F.coalesce("units", "settled", F.lit(0).cast("long")).cast("long").alias("units"), n("completed"), n("failed"), F.coalesce("failed_ids", no_ids).alias("failed_ids"))
    r = results.withColumns({"unit": F.row_number().over(whole.orderBy("seq")), "done": count(F.col("ok")), "lost": count(~F.col("ok"))}).join(both.select("run_id", "units"), "run_id")
    event = lambda k, name, **fields: F.struct(k.cast("int").alias("k"), F.lit(name).alias("event"), F.to_json(F.struct(*(v.alias(f) for f, v in fields.items()))).alias("payload"))
    col = F.col

    def retry(k: Column) -> Column:
        return event(k + 1, "unit-retry", id=col("id"), unit=col("unit"), units=col("units"), attempt=k + 2, attempts=col("retries") + 1, delayMs=progress.retry_delay(k), message=col("message"))

    retries = F.when(col("attempts") > 1, F.transform(F.sequence(F.lit(0), col("attempts") - 2), retry)).otherwise(F.array())
    settled = col("done") + col("lost")
    found = event(F.lit(100), "paragraph", id=col("id"), translation=col("translation"))
    failed = event(F.lit(100), "unit-error", id=col("id"), unit=col("unit"), units=col("units"), attempts=col("retries") + 1, message=col("message"))
    told = event(F.lit(101), "progress", unit=settled, sourceUnit=col("unit"), units=col("units"), completedUnits=col("done"), failedUnits=col("lost"), percent=progress.percent(settled, col("units")), rpmUsed=col("rpm_used"))
    start = event(F.lit(0), "unit-start", id=col("id"), unit=col("unit"), units=col("units"), inFlight=F.lit(1))
    each = r.select("run_id", "unit", F.explode(F.concat(F.array(start), retries, F.array(F.when(col("ok"), found).otherwise(failed), told))).alias("e"))
    meta = event(F.lit(0), "meta", units=col("units"), maxRpm=col("max_rpm"), maxConcurrency=col("max_concurrency"), model=col("model"), provider=col("provider"))
    done = event(F.lit(0), "done", units=col("units"), paragraphs=col("paragraphs"), completedUnits=col("completed"), failedUnits=col("failed"), failedIds=col("failed_ids"))
    broken = event(F.lit(0), "error", message=col("error"))
    last = F.lit(2**31 - 1)  # after every unit
    ends = both.select("run_id", F.explode(F.array(F.struct(F.lit(0).alias("unit"), meta.alias("e")), F.struct(last.alias("unit"), F.when(col("error").isNull(), done).otherwise(broken).alias("e")))).alias("x")).select("run_id", "x.unit", "x.e")
    rows = each.unionByName(ends)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("unit", "e.k")) - 1
    return rows.select("run_id", place.cast("long").alias("n"), "e.event", "e.payload")
