"""Runs as streams: stopped in the middle and taken up again."""

import json
import time

from folio.operators import dispatch
from folio.streaming import runs


def test_a_stopped_run_keeps_what_is_done(spark, tmp_path):
    folder, out, mark, calls = (f"{tmp_path}/{x}" for x in ("units", "out", "mark", "calls"))
    runs.put_units(spark.createDataFrame([(i // 4, f"u{i:02}", f"text {i}") for i in range(24)], "doc_id int, id string, text string"), folder, 6)

    def call(ident, text):
        with open(calls, "a") as f:
            f.write(ident + "\n")
        time.sleep(0.15)
        if ident == "u07":
            raise dispatch.Missing("nothing for u07")
        return f"[{text}"

    q = runs.run(spark, folder, out, mark, call)
    while not q.lastProgress and q.isActive:
        time.sleep(0.05)
    q.stop()
    some = runs.results(spark, out).count()
    assert 0 < some < 24
    runs.run(spark, folder, out, mark, call).awaitTermination()
    got = runs.results(spark, out).collect()
    assert len(got) == 24 and {r.id for r in got} == {f"u{i:02}" for i in range(24)} and [r.id for r in got if not r.ok] == ["u07"]
    made = open(calls).read().split()
    assert 24 <= len(made) <= 24 + 12  # no more than what was under way is called again
    runs.run(spark, folder, out, mark, call).awaitTermination()  # nothing is left
    assert len(open(calls).read().split()) == len(made)
    runs.put_units(spark.createDataFrame([(9, "new", "more")], "doc_id int, id string, text string"), folder, 1)
    runs.run(spark, folder, out, mark, call).awaitTermination()
    assert runs.results(spark, out).count() == 25

    about = spark.createDataFrame([("r", 10, 1, "m", "p", 3, None)], "run_id string, max_rpm int, max_concurrency int, model string, provider string, retries int, error string")
    ev = runs.events(spark, folder, out, about).orderBy("n").collect()
    assert ev[0].event == "meta" and json.loads(ev[0].payload)["units"] == 25 and ev[-1].event == "done" and json.loads(ev[-1].payload)["failedIds"] == ["u07"]
    assert sum(e.event == "paragraph" for e in ev) == 24 and [json.loads(e.payload)["message"] for e in ev if e.event == "unit-error"] == ["nothing for u07"]


def test_a_run_that_broke_off(spark, tmp_path):
    folder, out = f"{tmp_path}/units", f"{tmp_path}/out"
    runs.put_units(spark.createDataFrame([(1, "a", "x")], "doc_id int, id string, text string"), folder, 1)
    spark.createDataFrame([], dispatch.RESULT).write.parquet(out)
    about = spark.createDataFrame([("r", 10, 1, "m", "p", 3, "closed")], "run_id string, max_rpm int, max_concurrency int, model string, provider string, retries int, error string")
    assert [(e.event, json.loads(e.payload)) for e in runs.events(spark, folder, out, about).orderBy("n").collect()] == [("meta", {"units": 1, "maxRpm": 10, "maxConcurrency": 1, "model": "m", "provider": "p"}), ("error", {"message": "closed"})]
