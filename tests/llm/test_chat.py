import json
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from folio.llm import chat as C
from folio.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

JSON = st.recursive(st.one_of(st.none(), st.booleans(), st.integers(-(2**53), 2**53), st.floats(allow_nan=False, allow_infinity=False), st.text(st.characters(exclude_categories=["Cs"]), max_size=5)), lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.text("ab€\U0001f600￿", max_size=2), c, max_size=3)), max_leaves=8)


@given(JSON)
def test_canonical_round_trip(v):
    text = C.canonical(v)
    assert json.loads(text) == v and C.canonical(C.parsed(text)) == text


@pytest.mark.parametrize(("v", "text"), [(1.0, "1"), (1e21, "1e+21"), (1e-7, "1e-7"), (1.5e-6, "0.0000015"), (-2.5e-5, "-0.000025"), (1e20, "100000000000000000000"), (-0.0, "0"), (0.1, "0.1"), (1.5e300, "1.5e+300"), ({"￿": 1, "\U0001f600": 2, "a": [True, None]}, '{"a":[true,null],"\U0001f600":2,"￿":1}')])
def test_canonical_values(v, text):
    assert C.canonical(v) == text


@pytest.mark.parametrize("text", ["{", '{"a":1,"a":2}', "NaN", '"\\ud800"', "1e999", "[" * 100_000])
def test_not_i_json(text):
    with pytest.raises(ValueError):
        C.parsed(text)


def test_violation():
    s = {"type": "object", "required": ["a"], "additionalProperties": {"type": "number"}, "properties": {"a": {"type": ["integer", "null"], "minimum": 1}, "b": {"type": "array", "items": {"enum": ["x", 1]}, "maxItems": 2}, "c": {"const": 5, "type": "number"}, "d": {"type": "string", "minLength": 2}}}
    good = [{"a": 1}, {"a": None, "b": ["x", 1.0]}, {"a": 2.0, "c": 5, "z": 1.5}, {"a": 3, "d": "xy"}]
    bad = [[], {}, {"a": 0}, {"a": True}, {"a": 1.5}, {"a": 1, "b": ["y"]}, {"a": 1, "b": [1, 1, 1]}, {"a": 1, "c": 4}, {"a": 1, "z": "q"}, {"a": 1, "d": "x"}]
    assert [C.violation(v, s) for v in good] == [None] * len(good) and all(C.violation(v, s) for v in bad)


@given(st.lists(st.tuples(st.integers(0, 5), st.lists(st.integers(0, 9), max_size=3)), max_size=10))
def test_topological(spec):
    items = [(t, f"k{i}", f"c{i}", [f"c{d}" for d in deps]) for i, (t, deps) in enumerate(spec)]
    order, cyclic = C.topological(items)
    assert sorted(order) == list(range(len(items)))
    place = {i: p for p, i in enumerate(order)}
    for i, (_, deps) in enumerate(spec):
        for d in deps:
            if d < len(items) and i not in cyclic:
                assert place[d] < place[i]
    for i, j in zip(order, order[1:], strict=False):  # out of turn only for the sake of what is used
        if spec[j][0] < spec[i][0] and j not in cyclic:
            assert spec[j][1]
    done = set()
    while new := {i for i, (_, deps) in enumerate(spec) if i not in done and all(d in done or d >= len(spec) for d in deps)}:
        done |= new
    assert cyclic == set(range(len(items))) - done


def test_formats(spark):
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    messages = s([(1, 0, "system", "be kind", 1), (1, 9, "user", None, 1), (None, 0, "user", "x", 1), (None, 0, "user", "x", 1)], "conv_id long, turn long, role string, text string, key int")
    calls = s([(1, 1, "a", "ask", '{"length":3,"question":"why"}', ["b"]), (1, 2, "b", "recall", '{"question": 5}', []), (1, 3, "c", "ask", "{", ["c"]), (1, 4, "d", "none", "1.0", None), (2, 1, "a", "ask", None, []), (2, 1, "a", "ask", None, [])], "conv_id long, turn long, call_id string, name string, arguments string, after array<string>")
    results = s([(1, 5, "a", "late"), (1, 4, "a", "first"), (1, 4, "z", "lost"), (2, 2, "a", "two")], "conv_id long, turn long, call_id string, content string")
    got = sorted(C.format_chats(messages, calls, results, C.SCHEMAS).collect(), key=lambda r: (r.conv_id or 0, r.position))
    one = [(r.kind, r.call_id, r.status, r.cyclic, r.valid) for r in got if r.conv_id == 1]
    assert one == [("message", None, None, False, None), ("call", "b", "unanswered", False, False), ("call", "a", "linked", False, True), ("call", "d", "unanswered", False, False), ("call", "z", "orphan", False, None), ("message", None, None, False, None), ("call", "c", "unanswered", True, False)]
    row = {(r.conv_id, r.call_id): r for r in got if r.call_id}
    assert row[1, "a"].json == '{"result":{"content":"first","role":"tool","tool_call_id":"a"},"role":"assistant","tool_call":{"arguments":{"length":3,"question":"why"},"id":"a","name":"ask"}}'
    assert '"arguments":"{"' in row[1, "c"].json and '"arguments":1,' in row[1, "d"].json and row[1, "d"].error == "no schema of none"
    assert [r.status for r in got if r.conv_id == 2] == ["repeated"] * 2 and [r.position for r in got if r.conv_id is None] == [0, 0] and len(got) == 11
    assert C.format_chats(messages.limit(0), calls.limit(0), results.limit(0), {}).count() == 0


def test_whole_table_against_plain(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    random.Random(1).shuffle(rows)
    got = {(r.conv_id, r.turn): r for r in C.format_chats(*C.from_conversations(table), C.SCHEMAS).collect()}
    at = {(c, t): (role, text) for c, t, role, text in rows}
    n = 0
    for (c, t), (role, text) in at.items():
        if role == "user":
            after = [f"call_{x}" for x in dict.fromkeys((t + 2 * (len(text) % 5 - 2), t + 2 * (len(text) // 5 % 3 - 1))) if x >= 0 and x != t]
            args = {"question": text, "length": len(text)} | ({"after": after} if after else {})
            name = "ask" if t % 4 < 2 else "recall"
            want = {"role": "assistant", "tool_call": {"id": f"call_{t}", "name": name, "arguments": args}}
            nxt = at.get((c, t + 1))
            if nxt and nxt[0] == "assistant":
                want["result"] = {"role": "tool", "tool_call_id": f"call_{t}", "content": nxt[1]}
            r = got[c, t]
            assert r.json == json.dumps(want, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
            assert r.valid == (1 <= len(text) <= 1000 or name == "recall") and r.status == ("linked" if "result" in want else "unanswered")
            n += 1
        elif role == "system":
            assert json.loads(got[c, t].json) == {"role": role, "content": text}
            n += 1
    assert n > 20


def test_sql(spark):
    assert compare(spark, "op8_chat", "/root/testdata/sf0.01", QUERIES, ORACLE_SQL) > 300


def test_order_of_a_whole_table(spark):
    """Most conversations are out of turn, many hold a circle; every call outside of circles comes after what it uses."""
    m, calls, r = C.from_conversations(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet"))
    uses = {(x.conv_id, x.call_id): x.after for x in calls.collect()}
    rows = C.format_chats(m, calls, r, C.SCHEMAS).collect()
    place = {(x.conv_id, x.call_id): x.position for x in rows if x.call_id}
    turn = {(x.conv_id, x.position): x.turn for x in rows}
    late = {c for (c, p), t in turn.items() if p and t < turn[c, p - 1]}
    assert len(late) > 0.25 * len({c for c, _ in turn}) and sum(x.cyclic for x in rows) > 0.1 * len(rows)
    n = 0
    for x in rows:
        if x.kind == "call" and x.status != "orphan" and not x.cyclic:
            for d in uses[x.conv_id, x.call_id]:
                if (x.conv_id, d) in uses:
                    assert place[x.conv_id, d] < x.position
                    n += 1
    assert n > 300


@pytest.mark.parametrize("large", [100_000, 0])
def test_order_of_long_and_of_tangled_conversations(spark, monkeypatch, large):
    """A conversation in turn goes through the range sort, one whose calls come before what they use through the graph,
    in a task or level by level."""
    monkeypatch.setattr(C, "LARGE", large)
    rnd = random.Random(5)
    rows = [("cx", t, f"x{t:03}", f"c{t}", [f"c{t - 1}"] if t else []) for t in range(300)]
    rows += [("cy", t, f"y{t}", f"c{t}", [f"c{t + 1}"] if t % 2 == 0 else []) for t in range(10)]
    rows += [("cz", None, "z0", None, None), ("cz", 0, "z1", "c", []), ("cz", 1, "z2", "c", ["c"])]
    rows += [("cw", rnd.randrange(8), f"w{t:02}", rnd.choice([None, f"c{t // 2}"]), [f"c{rnd.randrange(12, 30)}" for _ in range(rnd.randrange(3))] if t < 25 else [f"c{rnd.randrange(40)}"] * (t % 3 == 0)) for t in range(60)]
    rows += [("cv", 9 - t, f"v{t}", f"c{t}", [f"c{t - 1}", f"c{t - 1}", "none"] if t else []) for t in range(10)]
    rnd.shuffle(rows)
    items = spark.createDataFrame(rows, "conv string, turn long, key string, call_id string, after array<string>").repartition(5)
    got = {r.key: (r.position, r.cyclic) for r in C.positions(items).collect()}
    assert len(got) == len(rows)
    for conv in ("cx", "cy", "cz", "cw", "cv"):
        own = [r for r in rows if r[0] == conv]
        order, cyclic = C.topological([(-1 if r[1] is None else r[1], r[2], r[3], r[4] or []) for r in own])
        assert [got[own[i][2]] for i in order] == [(p, i in cyclic) for p, i in enumerate(order)]
