"""One limit for all runs on a provider: grants of a stream over batches and restarts."""

import bisect
import random
import time

from folio.operators import dispatch
from folio.streaming import limits


def busiest(starts, span=60_000):
    starts = sorted(starts)
    return max(i + 1 - bisect.bisect_right(starts, t - span) for i, t in enumerate(starts))


def test_never_more_than_the_limit(spark, tmp_path):
    """Three runs, five batches, some of them late; the stream is a new one each time."""
    rnd = random.Random(2)
    asked, out, mark = (f"{tmp_path}/{x}" for x in ("asked", "out", "mark"))
    rows = [(rnd.choice(["p", "q"]), f"r{rnd.randrange(3)}", f"u{i:03}", rnd.randrange(300_000) + 200_000 * (i // 80), 4) for i in range(400)]
    rows += [(None, "r0", "u", 1, 4), ("p", "r0", "u", None, 4), ("p", "r0", "u", 1, None), ("s", None, None, 5, 0)]
    for k in range(5):
        spark.createDataFrame(rows[k * 81 : (k + 1) * 81], limits.REQUEST).coalesce(1).write.mode("append").parquet(asked)
        limits.serve(spark, asked, out, mark).awaitTermination()
    limits.serve(spark, asked, out, mark).awaitTermination()  # nothing has come
    got = spark.read.schema(limits.GRANT).parquet(out).collect()
    assert len(got) == 401 and len({(r.provider, r.unit) for r in got}) == 401 and all(r.start_ms >= r.ms for r in got)
    for p in ("p", "q"):
        own = [r.start_ms for r in got if r.provider == p]
        assert busiest(own) == 4 and len(own) > 150
    assert [(r.start_ms, r.run_id) for r in got if r.provider == "s"] == [(5, None)]


def test_calls_wait_for_their_time(spark, tmp_path):
    """Units of a run are sent at the times granted, in that order."""
    now = int(time.time() * 1000)
    units = spark.createDataFrame([(1, f"u{i}", f"text {i}") for i in range(6)], "doc_id long, id string, text string")
    granted = spark.createDataFrame([("p", "r1", f"u{i}", now, now + 3000 + 300 * (5 - i)) for i in range(6)] + [("p", "r2", "u0", now, 0)], limits.GRANT)

    def call(ident, text):
        return f"{int(time.time() * 1000)}"

    got = {r.id: r for r in dispatch.translate(limits.with_starts(units, granted, "r1"), call, concurrency=1, rpm=1).collect()}
    sent = [int(got[f"u{i}"].translation) for i in range(5, -1, -1)]
    assert len(got) == 6 and sent == sorted(sent) and all(s >= now + 3000 + 300 * k for k, s in enumerate(sent)) and all(r.ok for r in got.values())
