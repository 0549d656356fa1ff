"""Runs against a local HTTP server: wire styles, errors, quotas, cancelling; settings and the store."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from folio.operators import dispatch, wire
from folio.sources import files, sinks


class Model(BaseHTTPRequestHandler):
    seen: list = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        Model.seen.append((self.path, {k.lower(): v for k, v in self.headers.items()}, body))
        ask = body["messages"][-1]["content"]
        status, reply = 200, {"choices": [{"message": {"content": f"[{ask}"}}]}
        if "refuse" in ask:
            status, reply = 429, {"error": {"message": "slow down"}}
        data = b"<html>" if "garbled" in ask else json.dumps(reply).encode()
        self.send_response(status)
        self.end_headers()
        self.wfile.write(data)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def _prompt(ident, text):
    return json.dumps({"model": "m", "messages": [{"role": "user", "content": text}]})


def _read(payload, ident):
    return payload["choices"][0]["message"]["content"]


def test_translator_over_http(spark, server):
    Model.seen.clear()
    units = spark.createDataFrame([(1, "a", "one"), (1, "b", "refuse"), (2, "c", "garbled")], "doc_id long, id string, text string")
    t = wire.HttpTranslator(f"{server}/chat/completions", "openai", "k", _prompt, _read)
    got = {r.id: r for r in dispatch.translate(units, t, concurrency=2, retries=0).collect()}
    assert got["a"].translation == "[one" and got["a"].ok
    assert got["b"].error == "模型请求失败 (429)：slow down" and got["c"].error == "模型返回了无法解析的响应"
    assert {h["authorization"] for _, h, _ in Model.seen} == {"Bearer k"} and {p for p, _, _ in Model.seen} == {"/chat/completions"}
    status, raw, _ = wire.ping(f"{server}/messages", "anthropic", "k", _prompt("", "hello"))
    assert status == 200 and Model.seen[-1][1]["x-api-key"] == "k" and json.loads(raw)["choices"]
    assert wire.ping("http://127.0.0.1:9/x", "openai", "k", "{}", timeout=2)[0] == 0


def test_quotas_sum_up():
    for rpm in (1, 2, 7, 600):
        for workers in range(1, min(20, rpm) + 1):
            parts = [dispatch.quota(rpm, workers, w) for w in range(workers)]
            assert sum(parts) == rpm and min(parts) >= 1


def _slow(ident, text):
    time.sleep(60)
    return text


def test_cancel(spark):
    units = spark.range(4).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("id"), F.lit("x").alias("text"))
    ended = []

    def work():
        with dispatch.cancellable(spark, "run-7"):
            try:
                dispatch.translate(units, _slow, concurrency=2).collect()
            except Exception as e:
                ended.append(str(e))

    t = threading.Thread(target=work)
    t.start()
    began = time.time()
    while t.is_alive() and time.time() - began < 50:
        time.sleep(1)
        dispatch.cancel(spark, "run-7")
    t.join(1)
    assert ended and time.time() - began < 50


def test_settings_cascade(tmp_path):
    (tmp_path / "broken.json").write_text("{")
    files.save_settings(str(tmp_path / "sub" / "config.json"), {"A": "json", "D": "d", "n": 5})
    (tmp_path / "env").write_text("A=file\n")
    names = [str(tmp_path / "none.json"), str(tmp_path / "broken.json"), str(tmp_path / "sub" / "config.json")]
    assert files.json_settings(names) == {"A": "json", "D": "d", "n": 5} and files.json_settings(names[:2]) == {}
    assert files.settings({"B": "env"}, [str(tmp_path / "env")], names) == {"A": "file", "B": "env", "D": "d"}


def test_store_versions_and_meta(spark, tmp_path):
    s = sinks.DocumentStore(spark, str(tmp_path / "store"))
    for size in (1, 2):
        s.put(spark.createDataFrame([("a", size)], "id string, size int"))
    assert s.get("a").first().size == 2 and s.next_version() == 3
    s.delete(spark.createDataFrame([("a",)], "id string"))
    assert s.all().count() == 0 and s.get_meta("theme") is None
    s.set_meta("theme", "sage")
    s.set_meta("theme", "blue")
    assert s.get_meta("theme") == "blue"


def test_a_file_for_each_document(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "heading", "One", ""), (1, 2, "paragraph", "Two", ""), (2, 1, "paragraph", "Three", "")], "doc_id long, ord long, kind string, source string, translation string")
    sinks.write(rows, str(tmp_path / "md"), "doc_id", "ord", "parallel", "md")
    held = {p.parent.name: p.read_text() for p in (tmp_path / "md").rglob("*.txt")}
    assert held == {"doc_id=1": "## One\n\nTwo\n", "doc_id=2": "Three\n"}
