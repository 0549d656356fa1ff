"""Requests to text models in two wire styles as columns, their headers, and a Translator that sends them.

Addresses and bodies are columns, so a plan can show or store what would be sent. Keys are never part of a table: they
go into the headers of a Translator alone, which lives in the tasks that call.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import js, replies

# Allowed efforts, limits of replies, the version that the messages style asks for, the test's message.
EFFORTS = ["low", "medium", "high", "xhigh", "max"]
REPLY_TOKENS, TEST_TOKENS, TEMPERATURE = 8192, 8, 0.2
MESSAGES_VERSION = "2023-06-01"
TEST_MESSAGE = "Reply with OK."
# The model of a request that names none, by wire style; what is said of styles without a text interface,
# of replies that can't be used and of requests that failed.
MESSAGES_MODEL, CHAT_MODEL = "claude-sonnet-4-5", "deepseek-v4-flash-free"
NO_INTERFACE = "该供应商没有可直接调用的通用文本接口"
NO_INTERFACE_HINT = "，请配置自定义 OpenAI 兼容地址"
NOT_READABLE, NO_CONTENT, TEST_FAILED, FAILED = "模型返回了无法解析的响应", "请求成功，但模型没有返回内容", "请求失败 ({})：{}", "模型请求失败 ({})：{}"
DETAIL, PREVIEW, TEST_SECONDS = 500, 120, 30


def effort(c: Column) -> Column:
    """A reasoning effort, or null if it isn't one of EFFORTS."""
    e = F.lower(js.trim(js.text(c)))
    return F.when(e.isin(EFFORTS), e)


def address(style: Column, base_url: Column) -> Column:
    return F.concat(base_url, F.when(style == "anthropic", F.lit("/messages")).otherwise(F.lit("/chat/completions")))


def _messages(content: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), content.alias("content")))


def body(style: Column, model: Column, reasoning: Column, system: Column, source: Column, target: Column, units: Column) -> Column:
    """The JSON of a request for translations of units (array of id, text).

    The messages style has the system text in a field of its own (and the usual one in front of the prompt), the other in
    front of the prompt alone; a reasoning effort takes the place of the temperature. Null for the unsupported style.
    """
    e = effort(reasoning)
    plain = replies.prompt(F.lit(""), source, target, units)
    named = lambda usual: F.coalesce(js.truthy(js.text(model)), F.lit(usual)).alias("model")
    own = F.to_json(F.struct(named(MESSAGES_MODEL), F.lit(REPLY_TOKENS).alias("max_tokens"), replies.system_text(system).alias("system"), _messages(plain).alias("messages")))
    chat = F.to_json(F.struct(named(CHAT_MODEL), e.alias("reasoning_effort"), F.when(e.isNull(), F.lit(TEMPERATURE)).alias("temperature"), _messages(replies.prompt(system, source, target, units)).alias("messages")))
    return F.when(js.text(style) == "anthropic", own).when(js.text(style) != "unsupported", chat)


def request(style: Column, base_url: Column, model: Column, reasoning: Column, system: Column, source: Column, target: Column, units: Column) -> Column:
    """struct<url, body, error>: where to send what, or why there is nothing to send."""
    usable = js.text(style) != "unsupported"
    error = F.when(~usable, F.lit(NO_INTERFACE + NO_INTERFACE_HINT))
    return F.struct(F.when(usable, address(style, base_url)).alias("url"), body(style, model, reasoning, system, source, target, units).alias("body"), error.alias("error"))


def test_body(style: Column, model: Column, reasoning: Column) -> Column:
    """The JSON of a request that finds out whether a model answers."""
    ask = _messages(F.lit(TEST_MESSAGE))
    own = F.to_json(F.struct(model.alias("model"), F.lit(TEST_TOKENS).alias("max_tokens"), ask.alias("messages")))
    chat = F.to_json(F.struct(model.alias("model"), effort(reasoning).alias("reasoning_effort"), ask.alias("messages")))
    return F.when(style == "anthropic", own).when(style != "unsupported", chat)


def _filled(form: str, *values: Column) -> list[Column]:
    parts = [F.lit(x) for x in form.split("{}")]
    return [parts[0], *(c for pair in zip(values, parts[1:], strict=True) for c in pair)]


def test_result(status: Column, raw: Column) -> Column:
    """struct<ok, preview, error> of the reply to test_body()."""
    text = js.trim(replies.content(raw))
    ended = F.coalesce(F.get_json_object(raw, "$.choices[0].finish_reason"), F.get_json_object(raw, "$.stop_reason"))
    error = (
        F.when(~status.between(200, 299), F.concat(*_filled(TEST_FAILED, status.cast("string"), replies.error_detail(raw, 700))))
        .when(F.try_parse_json(raw).isNull(), F.lit(NOT_READABLE))
        .when((text == "") & js.truthy(ended).isNull(), F.lit(NO_CONTENT))
    )
    return F.struct(error.isNull().alias("ok"), F.when(error.isNull(), F.substring(text, 1, PREVIEW)).alias("preview"), error.alias("error"))


def headers(style: str, key: str) -> dict[str, str]:
    own = {"x-api-key": key, "anthropic-version": MESSAGES_VERSION} if style == "anthropic" else {"authorization": f"Bearer {key}"}
    return own | {"content-type": "application/json"}


class HttpTranslator:
    """A Translator for dispatch.translate(): one unit per request, by the standard library.

    prompt(ident, text) gives the request's JSON, as body() does for a row; read(content, ident) the translation or None.
    """

    def __init__(self, url: str, style: str, key: str, prompt, read, timeout: float = 300.0):
        self.url, self.style, self.key, self.prompt, self.read, self.timeout = url, style, key, prompt, read, timeout

    def __call__(self, ident: str, text: str) -> str | None:
        request = urllib.request.Request(self.url, self.prompt(ident, text).encode(), headers(self.style, self.key), method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                raw = reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as e:
            detail = e.read().decode("utf-8", "replace")
            try:
                detail = json.loads(detail)["error"]["message"] or detail
            except (ValueError, KeyError, TypeError):
                pass  # plain text
            raise RuntimeError(FAILED.format(e.code, detail[:DETAIL])) from None
        try:
            payload = json.loads(raw)
        except ValueError:
            raise RuntimeError(NOT_READABLE) from None
        return self.read(payload, ident)


def ping(url: str, style: str, key: str, request: str, timeout: float = TEST_SECONDS) -> tuple[int, str, float]:
    """(status, reply, seconds) of a test request; status 0 where there was no reply in time."""
    began = time.time()
    try:
        with urllib.request.urlopen(urllib.request.Request(url, request.encode(), headers(style, key), method="POST"), timeout=timeout) as reply:
            return reply.status, reply.read().decode("utf-8", "replace"), time.time() - began
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace"), time.time() - began
    except (OSError, TimeoutError) as e:
        return 0, str(e), time.time() - began
