"""Prompts for a translation model and the reading of its replies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import js

# The instruction that goes with each request.
INSTRUCTION = "请将下面的 {} 翻译为 {}。\n只返回 JSON 数组，不要 Markdown 代码块，不要解释。数组每一项必须包含 id 和 translation，id 必须原样保留。保留段落语气、专有名词、数字和标点。\n\n"
SOURCE, TARGET = "原文", "中文"
# Fixed value: the system text where a request names none.
SYSTEM = "你是一名专业翻译。"
# Fixed value: what a preview shows where there is no unit.
PLACEHOLDER = "{{此处替换为待翻译段落}}"
ITEM = "struct<id:string,translation:string>"


def system_text(c: Column) -> Column:
    return F.coalesce(js.truthy(js.text(c)), F.lit(SYSTEM))


def prompt(system: Column, source: Column, target: Column, units: Column) -> Column:
    """System text (SYSTEM where it is empty), instruction and the units (array of id, text) as compact JSON."""
    before, between, after = INSTRUCTION.split("{}")
    words = [F.lit(before), F.coalesce(js.truthy(source), F.lit(SOURCE)), F.lit(between), F.coalesce(js.truthy(target), F.lit(TARGET)), F.lit(after)]
    return F.concat(system_text(system), F.lit("\n\n"), *words, F.to_json(units))


def preview(style: Column, system: Column, source: Column, target: Column, units: Column) -> Column:
    """struct<system_prompt, user_prompt> for the first unit of an array, or for a placeholder."""
    first = F.slice(units, 1, 1)
    shown = F.when(F.size(first) > 0, first).otherwise(F.array(F.struct(F.lit("p-1").alias("id"), F.lit(PLACEHOLDER).alias("text"))))
    own = style == "anthropic"
    user = F.when(own, prompt(F.lit(""), source, target, shown)).otherwise(prompt(system, source, target, shown))
    return F.struct(F.when(own, system_text(system)).otherwise(F.lit("")).alias("system_prompt"), user.alias("user_prompt"))


def _joined(parts: Column) -> Column:
    """Texts of an array of reply parts (JSON objects)."""
    one = lambda p: F.coalesce(js.truthy(F.get_json_object(p, "$.text")), F.get_json_object(p, "$.content"), F.lit(""))
    return F.array_join(F.transform(parts, one), "")


def content(payload: Column) -> Column:
    """The text of a reply's JSON: content parts, or the first choice's message content or text."""
    listed = lambda path: F.from_json(F.get_json_object(payload, path), "array<string>")
    is_list = lambda path: js.test(F.get_json_object(payload, path), r"\A\[")
    choice = "$.choices[0].message.content"
    return (
        F.when(is_list("$.content"), _joined(listed("$.content")))
        .when(is_list(choice), _joined(listed(choice)))
        .otherwise(F.coalesce(F.get_json_object(payload, choice), F.get_json_object(payload, "$.choices[0].text"), F.lit("")))
    )


def _from_lines(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), js.trim), lambda x: x != "")

    def item(line: Column) -> Column:
        split = line.rlike(r"(?s)\A[^\t:：]+[\t:：]")
        right = js.trim(F.regexp_extract(line, r"(?s)\A[^\t:：]+[\t:：](.*)\z", 1))
        ident = F.when(split, js.trim(F.regexp_extract(line, r"(?s)\A([^\t:：]+)", 1))).otherwise(F.lit(""))
        return F.struct(ident.alias("id"), F.when(split & (right != ""), right).otherwise(line).alias("translation"))

    return F.transform(lines, item)


def items(raw: Column) -> Column:
    """array<id, translation> of a reply: its JSON array if it has one that parses, else one item per line.

    Code fences are taken off. A line is "id: text" (or with a tab or a full-width colon); a line without an id, or with
    nothing after it, is a text as a whole.
    """
    c = js.trim(F.regexp_replace(F.regexp_replace(js.text(raw), r"(?i)\A```(?:json)?", ""), r"```\z", ""))

    def read(c: Column) -> Column:
        body = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
        parsed = F.when(body != "", F.from_json(body, "array<struct<id:string,translation:string,translated:string,text:string>>", {"mode": "PERMISSIVE"}))
        whole = F.transform(parsed, lambda p: F.struct(F.coalesce(p["id"], F.lit("")).alias("id"), F.coalesce(p["translation"], p["translated"], p["text"], F.lit("")).alias("translation")))
        valid = (body != "") & F.try_parse_json(body).isNotNull() & parsed.isNotNull()
        return F.when(valid, whole).otherwise(_from_lines(c))

    return js.bind(c, read)


def matched(items: Column, ident: Column) -> Column:
    """The translation of a unit: that of its id, else of a lone item; null if that is empty."""
    own = F.get(F.filter(items, lambda i: i["id"] == ident), F.lit(0))["translation"]
    lone = F.when(F.size(items) == 1, F.get(items, F.lit(0))["translation"])
    found = F.exists(items, lambda i: i["id"] == ident)
    return js.truthy(F.when(found, own).otherwise(lone))


def error_detail(raw: Column, limit: int = 700) -> Column:
    """What an error reply says."""
    get = lambda p: js.truthy(F.get_json_object(raw, p))
    return F.substring(F.coalesce(get("$.error.message"), get("$.message"), get("$.detail"), raw), 1, limit)
