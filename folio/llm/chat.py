"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

Calls and results meet in a hash join on (conversation, identifier). The order of a conversation's items is topological: a
call comes after the calls whose results it uses. An item's time is the largest turn among its own and those of all that it
comes after, its level the length of the longest chain before it; items go by (time, level, turn, key), so each stands at
its turn unless what it uses comes later, and else right behind that. The order is found from identifiers alone; texts join
it afterwards. Where all calls of a conversation already come after what they use, by (turn, key), that is the order, and a
range sort over all conversations numbers it, however long one is. Other conversations are graphs: those of up to LARGE
items are ordered in one task each, which holds some tens of bytes per item; larger ones level by level with joins on
(conversation, identifier), all at once, in as many rounds as the longest chain has links. Arguments are validated against
JSON schemas and rows are written in the form of RFC 8785, row by row.

Defined cases: rows without a conversation are conversations of their own; a call without a result has status
"unanswered", a result without a call "orphan"; of several results of a call the one of the least turn (then text) is
taken and all are counted; calls that share an identifier share its results and have status "repeated"; identifiers that no
call has are ignored in the order; calls in a cycle come last, by turn, with cyclic set; null texts are null in JSON;
arguments that aren't I-JSON (syntax, repeated names, lone surrogates, numbers beyond doubles) are invalid and written
as the string they are; further columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import drop_scratch, materialise, only, ranked, runs

# --- canonical JSON -----------------------------------------------------------------------------------------------


def canonical(value) -> str:
    """RFC 8785: names sorted by UTF-16 units, no white space, numbers in their shortest ECMAScript form."""
    if value is None or isinstance(value, (bool, str)):
        text = json.dumps(value, ensure_ascii=False)
        text.encode()  # a lone surrogate raises here
        return text
    if isinstance(value, (int, float)):
        x = float(value)
        if not math.isfinite(x):
            raise ValueError("a number beyond doubles")
        if x == int(x) and abs(x) < 1e21:
            return str(int(x))
        digits, _, power = repr(x).partition("e")
        if power and -7 < int(power) < 0:  # ECMAScript writes these out
            sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
            return f"{sign}0.{'0' * (-int(power) - 1)}{digits.replace('.', '')}"
        return f"{digits.removesuffix('.0')}e{int(power):+d}" if power else digits
    if isinstance(value, dict):
        names = sorted(value, key=lambda n: n.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(n)}:{canonical(value[n])}" for n in names) + "}"
    return "[" + ",".join(map(canonical, value)) + "]"


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a name is repeated")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parsed(text: str):
    """The value of a JSON text; ValueError if it isn't I-JSON."""
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_no_constant)
        canonical(value)
    except (RecursionError, OverflowError) as e:
        raise ValueError(str(e)) from None
    return value


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violation(value, schema: dict, at: str = "$") -> str | None:
    """The first way in which a value breaks a schema (type, enum, const, properties, required, additionalProperties,
    items, minItems, maxItems, minLength, maxLength, minimum, maximum), or None."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kinds and not any(number and (k == "number" or value == int(value)) if k in ("number", "integer") else isinstance(value, _TYPES[k]) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    same = lambda v: canonical(v) == canonical(value)
    if "enum" in schema and not any(map(same, schema["enum"])) or "const" in schema and not same(schema["const"]):
        return f"{at}: not among the values"
    if number and not schema.get("minimum", -math.inf) <= value <= schema.get("maximum", math.inf):
        return f"{at}: out of range"
    for kind, least, most in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(value, kind) and not schema.get(least, 0) <= len(value) <= schema.get(most, math.inf):
            return f"{at}: length out of range"
    if isinstance(value, list) and "items" in schema:
        return next((e for i, v in enumerate(value) if (e := violation(v, schema["items"], f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known, more = schema.get("properties", {}), schema.get("additionalProperties", True)
        for n in schema.get("required", []):
            if n not in value:
                return f"{at}: {n} is missing"
        for n in sorted(value):
            sub = known.get(n, more)
            if sub is False:
                return f"{at}: {n} is unknown"
            if isinstance(sub, dict) and (e := violation(value[n], sub, f"{at}.{n}")):
                return e
    return None


# --- order --------------------------------------------------------------------------------------------------------


LARGE = 100_000  # items of a conversation that one task orders


def topological(items: list[tuple[int, str, str | None, list[str]]]) -> tuple[list[int], set[int]]:
    """Order of items (turn, key, call id or None, ids of calls they come after), and the items that lie on or
    after a cycle, which are last, by turn and key. An item waits for identifiers, not for each call that has one."""
    owners: dict[str, list[int]] = {}
    for i, (_, _, c, _) in enumerate(items):
        if c is not None:
            owners.setdefault(c, []).append(i)
    missing = {c: len(x) for c, x in owners.items()}  # calls of an identifier that have no place yet
    until: dict[str, int] = {}  # the time from which its results are there
    users: dict[str, list[int]] = {}
    waits, time, level = [0] * len(items), [t for t, *_ in items], [-1] * len(items)
    for i, (_, _, _, deps) in enumerate(items):
        for d in {d for d in deps if d in owners}:
            waits[i] += 1
            users.setdefault(d, []).append(i)
    ready, n = [i for i, w in enumerate(waits) if not w], 0
    while ready:
        done, ready = ready, []
        for i in done:
            level[i] = n
        for i in done:
            if (c := items[i][2]) is None:
                continue
            missing[c] -= 1
            until[c] = max(until.get(c, time[i]), time[i])
            if not missing[c]:
                for j in users.get(c, []):
                    waits[j] -= 1
                    time[j] = max(time[j], until[c])
                    if not waits[j]:
                        ready.append(j)
        n += 1
    left = [i for i, x in enumerate(level) if x < 0]
    out = sorted((i for i, x in enumerate(level) if x >= 0), key=lambda i: (time[i], level[i], items[i][0], items[i][1], i))
    return out + sorted(left, key=lambda i: (items[i][0], items[i][1], i)), set(left)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, at in runs(batches, ["conv"]):
        turns, keys, calls, deps = (t.column(c).to_pylist() for c in ("turn", "key", "call_id", "after"))
        position, cyclic = [0] * t.num_rows, [False] * t.num_rows
        for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            order, cycle = topological([(-1 if turns[i] is None else turns[i], keys[i], calls[i], deps[i] or []) for i in range(s, e)])
            for p, i in enumerate(order):
                position[s + i], cyclic[s + i] = p, i in cycle
        yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(position, pa.int64()), pa.array(cyclic)], ["key", "position", "cyclic"])


# --- the operator -------------------------------------------------------------------------------------------------


def _conversation(df: DataFrame) -> DataFrame:
    """With conv: the conversation as a string, or a name of its own."""
    return df.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.concat(F.lit("u"), F.uuid())))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls (conv_id, turn, call_id, name, arguments, after) with result, n_results and status, and orphan results."""
    calls = _conversation(only(calls, "conv_id", "turn", "call_id", "name", "arguments", "after"))
    results = _conversation(only(results, "conv_id", "turn", "call_id", "content"))
    keys = ["conv", "call_id"]
    best = results.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("r"), F.count("*").alias("n_results"))
    best = materialise(best.select(*keys, "r", "n_results"), "results")
    used = materialise(calls.groupBy(*keys).agg(F.count("*").alias("n_calls")), "call-ids")
    linked = calls.join(best.hint("shuffle_hash"), keys, "left").join(used, keys, "left")
    status = F.when(F.col("n_calls") > 1, "repeated").when(F.col("n_results").isNull(), "unanswered").otherwise("linked")
    linked = linked.select("conv", "conv_id", "turn", "call_id", "name", "arguments", "after", F.col("r.content").alias("content"), F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"), status.alias("status"))
    alone = results.join(used, keys, "left_anti")
    none = lambda t: F.lit(None).cast(t)
    return linked.unionByName(alone.select("conv", "conv_id", "turn", "call_id", none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("after"), "content", F.lit(1).cast("long").alias("n_results"), F.lit("orphan").alias("status")))


def positions(items: DataFrame) -> DataFrame:
    """(key, position, cyclic) of items (conv, turn, key, call_id, after)."""
    n = max(12, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1).cast("long"))
    narrow = items.select("conv", turn.alias("turn"), "key", "call_id", "after")
    last = narrow.where("call_id is not null").groupBy("conv", "call_id").agg(F.max(F.struct("turn", "key")).alias("last"))
    last = materialise(last, "owners")  # tables, so that Spark can split hot keys of the joins
    uses = narrow.select("conv", F.struct("turn", "key").alias("own"), F.explode("after").alias("call_id"))
    late = materialise(uses.join(last, ["conv", "call_id"]).where("last >= own").select("conv").distinct(), "late")
    drop_scratch(last)
    graphs = materialise(narrow.join(late, "conv", "left_semi"), "graphs")
    large = materialise(graphs.groupBy("conv").count().where(F.col("count") > LARGE).select("conv"), "large")
    small = graphs.join(large, "conv", "left_anti").repartition(n, "conv").sortWithinPartitions("conv")
    by_turn = narrow.join(late, "conv", "left_anti").select("conv", "key", "turn", F.lit(False).alias("cyclic"), F.col("turn").alias("time"), F.lit(0).alias("level"))
    by_level = _levels(graphs.join(large, "conv", "left_semi")) if not large.isEmpty() else by_turn.limit(0)
    numbered = ranked(by_turn.unionByName(by_level), ["conv", "cyclic", "time", "level", "turn", "key"], "in-order")
    first = materialise(numbered.groupBy("conv").agg(F.min("_rank").alias("first")), "first")
    plain = numbered.join(first, "conv").select("key", (F.col("_rank") - F.col("first")).alias("position"), "cyclic")
    return plain.unionByName(small.mapInArrow(_ordered, "key string, position long, cyclic boolean"))


def _levels(items: DataFrame) -> DataFrame:
    """(conv, key, turn, cyclic, time, level) of items, level by level: those are next that only use calls with a place.

    Each round joins the identifiers that have become complete with the uses that still wait for them, and keeps what is
    left of both in written tables.
    """
    ids = ["conv", "call_id"]
    owners = items.where("call_id is not null").groupBy(*ids).agg(F.count("*").alias("n"))
    uses = items.select("conv", "key", F.explode(F.array_distinct("after")).alias("call_id")).join(owners.select(*ids), ids)
    uses = materialise(uses, "uses")
    waits = uses.groupBy("conv", "key").agg(F.count("*").alias("waits"))
    state = items.select("conv", "key", "turn", "call_id").join(waits, ["conv", "key"], "left").select("conv", "key", "turn", "call_id", F.coalesce("waits", F.lit(0).cast("long")).alias("waits"), F.col("turn").alias("time"))
    state, counts, placed, n = materialise(state, "waiting"), materialise(owners, "owners"), [], 0
    known = None  # (conv, call_id, have, until): how many calls of an identifier have their place
    while True:
        now = materialise(state.where("waits = 0").select("conv", "key", "turn", "call_id", "time"), "level")
        if now.isEmpty():
            break
        placed.append(now.select("conv", "key", "turn", F.lit(False).alias("cyclic"), "time", F.lit(n).alias("level")))
        have = now.where("call_id is not null").groupBy(*ids).agg(F.count("*").alias("have"), F.max("time").alias("until"))
        if known is not None:
            have = have.unionByName(known).groupBy(*ids).agg(F.sum("have").alias("have"), F.max("until").alias("until"))
        have = materialise(have.join(counts, ids).select(*ids, "have", "until", "n"), "have")
        known = have.where("have < n").select(*ids, "have", "until")
        free = uses.join(have.where("have = n").select(*ids, "until"), ids).groupBy("conv", "key").agg(F.count("*").alias("freed"), F.max("until").alias("until"))
        left = state.where("waits > 0").join(free, ["conv", "key"], "left")
        left = left.select("conv", "key", "turn", "call_id", (F.col("waits") - F.coalesce("freed", F.lit(0).cast("long"))).alias("waits"), F.greatest("time", "until").alias("time"))
        state, n = materialise(left, "waiting"), n + 1
    rest = state.where("waits > 0").select("conv", "key", "turn", F.lit(True).alias("cyclic"), F.col("turn").alias("time"), F.lit(0).alias("level"))
    return functools.reduce(DataFrame.unionByName, placed, rest)


def _written(schemas: dict[str, dict]):
    def row(r: dict) -> tuple[bool | None, str | None, str]:
        if r["kind"] == "message":
            return None, None, canonical({"role": r["role"], "content": r["content"]})
        if r["status"] == "orphan":
            return None, None, canonical({"role": "tool", "tool_call_id": r["call_id"], "content": r["content"]})
        error, value = None, r["arguments"]
        try:
            value = parsed(r["arguments"]) if r["arguments"] is not None else None
            error = f"no schema of {r['name']}" if r["name"] not in schemas else violation(value, schemas[r["name"]])
        except ValueError as e:
            error = f"not JSON: {e}"
        out = {"role": "assistant", "tool_call": {"id": r["call_id"], "name": r["name"], "arguments": value}}
        if r["n_results"]:
            out["result"] = {"role": "tool", "tool_call_id": r["call_id"], "content": r["content"]}
        return error is None, error, canonical(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [row(r) for r in b.to_pylist()]
            cols = [pa.array([d[i] for d in done], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv_id", "position", "turn", "kind", "call_id", "status", "cyclic")), *cols], ["conv_id", "position", "turn", "kind", "call_id", "status", "cyclic", "valid", "error", "json"])

    return run


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """(conv_id, position, turn, kind, call_id, status, cyclic, valid, error, json) of each item of each conversation.

    messages: (conv_id, turn, role, text); calls and results as in link(). A call's row holds its result.
    """
    m = _conversation(only(messages, "conv_id", "turn", "role", "text"))
    none = lambda t: F.lit(None).cast(t)
    items = link(calls, results).withColumns({"kind": F.lit("call"), "role": none("string")})
    items = items.unionByName(m.select("conv", "conv_id", "turn", none("string").alias("call_id"), none("string").alias("name"), none("string").alias("arguments"), none("array<string>").alias("after"), F.col("text").alias("content"), F.lit(0).cast("long").alias("n_results"), none("string").alias("status"), F.lit("message").alias("kind"), "role"))
    key = F.concat_ws("|", F.col("kind"), F.coalesce("call_id", F.lit("")), F.sha1(F.concat_ws("|", F.coalesce("name", F.lit("")), F.coalesce("arguments", F.lit("")), F.coalesce("role", F.lit("")), F.coalesce("content", F.lit("")))), F.uuid())
    items = materialise(items.withColumn("key", key), "items")
    both = items.join(positions(items), "key").select("conv_id", "position", "turn", "kind", "call_id", "status", "cyclic", "name", "arguments", "content", "n_results", "role")
    f = {x.name: x.dataType.simpleString() for x in items.schema}
    return both.mapInArrow(_written(schemas), f"conv_id {f['conv_id']}, position long, turn {f['turn']}, kind string, call_id string, status string, cyclic boolean, valid boolean, error string, json string")


SCHEMAS = {
    "ask": {"type": "object", "required": ["question", "length"], "additionalProperties": False, "properties": {"question": {"type": "string", "minLength": 1}, "length": {"type": "integer", "minimum": 1, "maximum": 1000}, "after": {"type": "array", "items": {"type": "string"}}}},
    "recall": {"type": "object", "required": ["question"], "properties": {"question": {"type": "string"}, "after": {"type": "array", "items": {"type": "string"}, "minItems": 1}}},
}


def _call_id(turn: Column) -> Column:
    return F.concat(F.lit("call_"), turn.cast("string"))


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, calls, results) of a plain table of turns: a user's turn is a call, the assistant's turn right after
    it (by number) its result. A call uses the results of up to two others, up to four turns before or behind it, which
    the length of its text picks; so uses run against turns as well, and in circles. All else are messages."""
    c = only(conversations, "conv_id", "turn", "role", "text")
    user = c.where("role = 'user'")
    size = F.coalesce(F.length("text"), F.lit(0))
    picked = [F.col("turn") + 2 * (size % 5 - 2), F.col("turn") + 2 * (F.floor(size / 5) % 3 - 1)]
    other = F.filter(F.array_distinct(F.array(*picked)), lambda t: (t >= 0) & (t != F.col("turn")))
    after = F.coalesce(F.transform(other, _call_id), F.array().cast("array<string>"))
    args = F.to_json(F.struct(F.col("text").alias("question"), F.length("text").alias("length"), F.when(F.size(after) > 0, after).alias("after")))
    calls = user.select("conv_id", "turn", _call_id(F.col("turn")).alias("call_id"), F.when(F.col("turn") % 4 < 2, "ask").otherwise("recall").alias("name"), args.alias("arguments"), after.alias("after"))
    results = c.where("role = 'assistant' and turn >= 1").select("conv_id", "turn", _call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return c.where("role is null or role not in ('user', 'assistant') or role = 'assistant' and (turn is null or turn < 1)"), calls, results


# What from_conversations() and SCHEMAS make of a table whose turns have a number each; RFC 8785 is written out. The
# recursion holds a conversation's times and levels as lists, null where an item has none yet, and fills in a level a round.
ORACLE = """
WITH RECURSIVE calls AS (SELECT conv_id, turn, text, 'call_' || turn AS call_id, CASE WHEN turn % 4 < 2 THEN 'ask' ELSE 'recall' END AS name,
    list_filter(CASE WHEN a = b THEN [a] ELSE [a, b] END, lambda t: t >= 0 AND t <> turn) AS uses
  FROM (SELECT *, turn + 2 * (length(text) % 5 - 2) AS a, turn + 2 * ((length(text) // 5) % 3 - 1) AS b FROM conversations WHERE role = 'user')),
results AS (SELECT conv_id, turn, 'call_' || (turn - 1) AS call_id, text AS content FROM conversations WHERE role = 'assistant' AND turn >= 1),
best AS (SELECT conv_id, call_id, arg_min({'c': content}, (turn, content)).c AS content, true AS there FROM results GROUP BY ALL),
items AS (
  SELECT c.conv_id, turn, 'call' AS kind, c.call_id, uses, CASE WHEN count(*) OVER (PARTITION BY c.conv_id, c.call_id) > 1 THEN 'repeated' WHEN there THEN 'linked' ELSE 'unanswered' END AS status,
         name = 'recall' OR length(text) BETWEEN 1 AND 1000 AS valid,
         CASE WHEN there THEN '{"result":{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"' || c.call_id || '"},"role"' ELSE '{"role"' END || ':"assistant","tool_call":{"arguments":{'
           || CASE WHEN len(uses) > 0 THEN '"after":["call_' || array_to_string(uses, '","call_') || '"],' ELSE '' END || '"length":' || length(text) || ',"question":' || to_json(text)::VARCHAR || '},"id":"' || c.call_id || '","name":"' || name || '"}}' AS json
  FROM calls c LEFT JOIN best b ON b.conv_id = c.conv_id AND b.call_id = c.call_id
  UNION ALL
  SELECT conv_id, turn, 'call', call_id, [], 'orphan', NULL, '{"content":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"' || call_id || '"}' FROM results r
  WHERE NOT EXISTS (SELECT 1 FROM calls c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
  UNION ALL
  SELECT conv_id, turn, 'message', NULL, [], NULL, NULL, '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' FROM conversations
  WHERE role IS NULL OR role NOT IN ('user', 'assistant') OR role = 'assistant' AND (turn IS NULL OR turn < 1)),
g AS (SELECT conv_id, list({'t': coalesce(turn, -1), 'u': uses, 'c': kind = 'call' AND status <> 'orphan'} ORDER BY coalesce(turn, -1)) AS xs FROM items GROUP BY conv_id),
h AS (SELECT conv_id, xs, list_transform(xs, lambda x: list_filter(range(1, len(xs) + 1), lambda j: xs[j].c AND list_contains(x.u, xs[j].t))) AS deps FROM g),
r(conv_id, n, times, levels) AS (
  SELECT conv_id, 0, list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN len(deps[i]) = 0 THEN xs[i].t END), list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN len(deps[i]) = 0 THEN 0 END) FROM h
  UNION ALL
  SELECT r.conv_id, n + 1,
         list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN times[i] IS NOT NULL THEN times[i] WHEN len(list_filter(deps[i], lambda j: times[j] IS NULL)) = 0 THEN greatest(xs[i].t, list_max(list_transform(deps[i], lambda j: times[j]))) END),
         list_transform(range(1, len(xs) + 1), lambda i: CASE WHEN levels[i] IS NOT NULL THEN levels[i] WHEN len(list_filter(deps[i], lambda j: levels[j] IS NULL)) = 0 THEN n + 1 END)
  FROM r JOIN h USING (conv_id) WHERE n < len(xs)),
o AS (SELECT conv_id, unnest(list_transform(xs, lambda x: x.t)) AS t, unnest(times) AS time, unnest(levels) AS level FROM r JOIN h USING (conv_id) WHERE n = len(xs))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY level IS NULL, coalesce(time, t), coalesce(level, 0), t) - 1 AS position, turn, kind, call_id, status, level IS NULL AS cyclic, valid, CASE WHEN NOT valid THEN '$.length: out of range' END AS error, json
FROM items JOIN o USING (conv_id) WHERE t = coalesce(turn, -1)
"""
