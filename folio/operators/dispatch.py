"""Dispatch of translation units: bounded workers, retries, a rate limit, results and the log of attempts.

A Translator is called once per unit, in mapInPandas over as many partitions as there are workers. A rate limit is dealt
to the workers as quotas that sum up to it, each with a log of its own, so that in any 60 s there are no more starts than
the limit allows and no task holds all units. cancel() ends the tasks of a run. Task retries can call again: results are keyed by (doc_id, id), and a restarted run takes only what has no
result yet (progress.unfinished).
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

RESULT = "doc_id long, id string, text string, translation string, ok boolean, error string, attempts int, waited_ms long"


class Missing(Exception):
    """The reply was read but has nothing for the unit; not tried again."""


class Translator(Protocol):
    def __call__(self, ident: str, text: str) -> str: ...


class SlidingLog:
    """At most rpm starts in any 60 s; clock and sleep are in seconds."""

    def __init__(self, rpm: int, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.rpm, self.clock, self.sleep, self.starts, self.lock = rpm, clock, sleep, deque(), Lock()

    def wait(self) -> float:
        began = self.clock()
        with self.lock:
            while True:
                now = self.clock()
                while self.starts and self.starts[0] <= now - 60:
                    self.starts.popleft()
                if len(self.starts) < self.rpm:
                    self.starts.append(now)
                    return now - began
                self.sleep(max(0.0, self.starts[0] + 60.03 - now))


def attempt(translator: Translator, ident: str, text: str, retries: int, limiter: SlidingLog | None, sleep: Callable[[float], None]) -> tuple[str | None, str | None, int, float]:
    """(translation, error, attempts, seconds waited for the limiter) of one unit."""
    waited, error = 0.0, None
    for k in range(retries + 1):
        if limiter:
            waited += limiter.wait()
        try:
            out = translator(ident, text)
            if out:
                return out, None, k + 1, waited
            return None, "no translation of this unit", k + 1, waited
        except Missing as e:
            return None, str(e), k + 1, waited
        except Exception as e:  # a unit's failure is its own
            error = str(e)
            if k < retries:
                sleep(min(1500 * 2**k, 8000) / 1000)
    return None, error, retries + 1, waited


def translate(units: DataFrame, translator: Translator, concurrency: int = 1, retries: int = 3, rpm: int | None = None, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(doc_id, id, text, translation, ok, error, attempts, waited_ms) of units (doc_id, id, text).

    Units with a start_ms (limits.grants) wait for that time instead of for a log of this job's own, so that the limit
    holds over all runs; only a call that is tried again after an error goes beyond it.
    """
    concurrency, retries = min(20, max(1, concurrency)), min(5, max(0, retries))

    granted = "start_ms" in units.columns
    rpm = min(600, max(1, rpm)) if rpm else None
    workers = min(concurrency, rpm) if rpm else concurrency

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limiter = SlidingLog(quota(rpm, workers, TaskContext.get().partitionId())) if rpm and not granted else None
        for f in frames:
            done = []
            for i, t, at in zip(f["id"], f["text"], f["start_ms"] if granted else [0] * len(f), strict=True):
                wait = max(0.0, at / 1000 - time.time()) if granted else 0.0
                if wait:
                    sleep(wait)
                ok, error, tries, waited = attempt(translator, i, t, retries, limiter, sleep)
                done.append((ok, error, tries, waited + wait))
            out = f[["doc_id", "id", "text"]].copy()
            out["translation"] = [d[0] for d in done]
            out["ok"] = [d[0] is not None for d in done]
            out["error"] = [d[1] for d in done]
            out["attempts"] = [d[2] for d in done]
            out["waited_ms"] = [int(d[3] * 1000) for d in done]
            yield out

    if not granted:
        return units.select("doc_id", "id", "text").repartition(workers).mapInPandas(run, RESULT)
    asked = units.select("doc_id", "id", "text", "start_ms").repartition(workers).sortWithinPartitions("start_ms", "id")
    return asked.mapInPandas(run, RESULT)


def quota(rpm: int, workers: int, worker: int) -> int:
    """A worker's part of the limit; the parts of all workers sum up to it."""
    return rpm // workers + (worker < rpm % workers)


@contextmanager
def cancellable(spark: SparkSession, run_id: str):
    """Jobs started inside, in this thread, can be ended by cancel()."""
    spark.sparkContext.addJobTag(run_id)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(run_id)


def cancel(spark: SparkSession, run_id: str) -> None:
    """End the jobs of a run; units that had a result keep it where results are written as they come."""
    spark.sparkContext.cancelJobsWithTag(run_id)
