"""A request limit that is the provider's: one log of starts for all runs, in the state of a stream.

Runs ask by adding rows to a folder; the stream answers each with the time at which it may start. The log outlives runs,
tasks and restarts, as it is in the checkpoint, and the answers are appended once each. dispatch.translate() waits for a
start_ms that it is given instead of keeping a log of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.progress import SLACK_MS, WINDOW_MS

MAX_RPM = 600
CHUNK = 65536  # answers that a task passes on at a time
REQUEST = "provider string, run_id string, unit string, ms long, rpm int"
GRANT = "provider string, run_id string, unit string, ms long, start_ms long"


def _grant(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    starts = list(state.get[0]) if state.exists else []
    # as Arrow strings and numbers, a tenth of what rows of Python strings take; frames go as they come
    held = [pa.table({"run_id": pa.array(f["run_id"], pa.string()), "unit": pa.array(f["unit"], pa.string()), "ms": pa.array(f["ms"], pa.int64()), "rpm": pa.array(f["rpm"], pa.int32())}) for f in frames]
    asked = pa.concat_tables(held)
    del held
    order = pc.sort_indices(asked, [("ms", "ascending"), ("run_id", "ascending"), ("unit", "ascending")])
    for at in range(0, len(order), CHUNK):
        part = asked.take(order.slice(at, CHUNK))
        out = []
        for ms, rpm in zip(part["ms"].to_pylist(), part["rpm"].to_pylist(), strict=True):
            now = max(ms, starts[-1] if starts else ms)
            rpm = min(MAX_RPM, max(1, int(rpm)))
            if len(starts) >= rpm and starts[-rpm] > now - WINDOW_MS:
                now = starts[-rpm] + WINDOW_MS + SLACK_MS
            starts.append(now)
            del starts[:-MAX_RPM]
            out.append(now)
        if at + CHUNK >= len(order):
            state.update((starts,))
        yield pd.DataFrame({"provider": key[0], "run_id": part["run_id"].to_pandas(), "unit": part["unit"].to_pandas(), "ms": part["ms"].to_pandas(), "start_ms": out})


def grants(requests: DataFrame) -> DataFrame:
    """A stream of GRANT for one of REQUEST: first come first served per provider, whatever run asks.

    A request of limit rpm starts when fewer than rpm starts of its provider lie in the 60 s before; of one batch the
    earlier request (then run, then unit) goes first, and none starts before one of an earlier batch. A task holds the
    requests of one provider in a batch, and the last 600 starts. Rows without a provider, a time or a limit get no answer.
    """
    sound = requests.where("provider is not null and ms is not null and rpm is not null")
    return sound.groupBy("provider").applyInPandasWithState(_grant, GRANT, "starts array<bigint>", "append", GroupStateTimeout.NoTimeout)


def serve(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Answer the requests that came to a folder since the last call (Parquet, REQUEST), as Parquet under out."""
    asked = spark.readStream.schema(REQUEST).parquet(folder)
    return grants(asked).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def with_starts(units: DataFrame, granted: DataFrame, run_id: str) -> DataFrame:
    """units (doc_id, id, text) of a run with start_ms, the time that its request (unit: the id) was given."""
    own = granted.where(F.col("run_id") == run_id).select(F.col("unit").alias("id"), "start_ms")
    return units.join(own, "id")
