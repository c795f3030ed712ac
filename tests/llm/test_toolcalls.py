import json
import random

import pytest
from support import assert_same
from hypothesis import given
from hypothesis import strategies as st

from mosaicflow.llm import toolcalls as tc
from mosaicflow.llm.queries import OP2_SQL, op2_tool_linking

SCHEMAS = {"add": {"type": "object", "properties": {"a": {"type": "number"}, "b": {}}, "required": ["a"], "additionalProperties": False}}
MESSAGES = "conv_id long, turn long, role string, text string, kind string, key long"


def call(id_, name="add", arguments=None, **extra):
    return f"<tool_call>{json.dumps({'id': id_, 'name': name, 'arguments': arguments if arguments is not None else {'a': 1}, **extra})}</tool_call>"


def result(id_, content=None):
    return f"<tool_response>{json.dumps({'tool_call_id': id_, 'content': content})}</tool_response>"


def linked(frame, *messages):
    rows = [(c, t, r, x, "k", 1) for c, t, r, x in messages]
    return tc.link(frame(rows, MESSAGES), SCHEMAS).collect()


def test_same_as_sql(spark, sf_dir, duck):
    assert_same(op2_tool_linking(spark, sf_dir), duck, OP2_SQL)


def test_statuses(frame):
    got = linked(
        frame, (1, 0, "assistant", call("x") + call("y", arguments={"a": "no", "c": 2})), (1, 1, "tool", result("x", {"v": 1.0})), (1, 2, "assistant", call("x", arguments={"a": 2})), (1, 3, "tool", result("x", 2)),
        (1, 4, "tool", result("z")), (2, 0, "assistant", call("x")), (None, 0, "assistant", call("x")), (None, None, "tool", result("x", "é")), (3, 0, "assistant", "<tool_call>{oops</tool_call> text"), (3, 1, "tool", "nonsense"),
        (3, 2, "user", call("q")), (3, 3, "assistant", None), (3, 4, "tool", ""), (4, 0, "assistant", json.dumps({"tool_calls": [{"id": "o", "type": "function", "function": {"name": "add", "arguments": "{\"a\": 1}"}}, {"function": {}}]})),
    )
    by = {(r.conv_id, r.call_id, r.status): r for r in got}
    assert set(by) == {
        (1, "x", "linked"), (1, "x", "repeated_call"), (1, "x", "repeated_result"), (1, "y", "unanswered"), (1, "z", "orphan"), (2, "x", "unanswered"), (None, "x", "linked"),
        (3, None, "unreadable"), (4, "o", "unanswered"), (4, None, "unreadable"),
    }
    assert by[1, "x", "linked"].call_json == '{"arguments":{"a":1},"id":"x","name":"add","result":{"v":1}}'
    assert by[None, "x", "linked"].call_json == '{"arguments":{"a":1},"id":"x","name":"add","result":"é"}'
    assert sorted(by[1, "y", "unanswered"].errors) == ["/a: type", "/c: unknown"]
    assert by[4, "o", "unanswered"].errors == []
    assert sum(r.status == "unreadable" and r.conv_id == 3 for r in got) == 2


def test_order_and_cycles(frame):
    ref = lambda *ids: {"a": 1, "b": [{"$ref": i} for i in ids]}
    got = linked(
        frame, (1, 0, "assistant", call("c", arguments=ref("b", "a"))), (1, 1, "assistant", call("b", arguments=ref("a")) + call("d", arguments=ref("none"))), (1, 2, "assistant", call("a")),
        (2, 0, "assistant", call("a")), (2, 1, "assistant", call("b", arguments=ref("a"))), (3, 0, "assistant", call("p", arguments=ref("q"))), (3, 1, "assistant", call("q", arguments=ref("p")) + call("r") + call("s", arguments=ref("p"))),
    )
    level = {(r.conv_id, r.call_id): r.level for r in got}
    assert level == {(1, "a"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 0, (2, "a"): 0, (2, "b"): 1, (3, "p"): None, (3, "q"): None, (3, "r"): 0, (3, "s"): None}
    assert {r.call_id for r in got if r.status == "cyclic"} == {"p", "q", "s"}


@pytest.mark.parametrize("group", [0, 100_000])
def test_levels_against_brute_force(frame, group):
    """Random references, some in cycles, in one task and in rounds."""
    rng = random.Random(group)
    needs = {c: {f"c{i}": sorted({f"c{rng.randrange(n + 3)}" for _ in range(rng.randrange(3))}) for i in range(n)} for c, n in enumerate((1, 3, 8, 20, 40))}
    needs[9] = {f"c{i}": [f"c{i + 1}"] for i in range(1000)}
    needs[10] = {"c0": ["c3"]} | {f"c{i}": [f"c{i - 1}"] for i in range(1, 200)}

    def level(calls, k, above=()):
        if k in above:
            return None
        own = [level(calls, r, (*above, k)) for r in calls[k] if r in calls]
        return None if None in own else 1 + max(own, default=-1)

    wanted = {(c, k): level(calls, k) for c, calls in needs.items() if c < 9 for k in calls}
    wanted |= {(9, f"c{i}"): 999 - i for i in range(1000)} | {(10, f"c{i}"): None for i in range(200)}
    rows = [(c, i, "assistant", call(k, arguments={"a": 1, "b": [{"$ref": r} for r in own]}), "k", 1) for c, calls in needs.items() for i, (k, own) in enumerate(calls.items())]
    got = tc.link(frame(rows, MESSAGES), SCHEMAS, group=group).collect()
    assert {(r.conv_id, r.call_id): r.level for r in got} == wanted
    assert {(r.conv_id, r.call_id) for r in got if r.status == "cyclic"} == {k for k, v in wanted.items() if v is None}


def test_identifiers_are_hash_joined(spark, sf_dir):
    plan = op2_tool_linking(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_deep_and_long_json(frame):
    deep = "[" * 150 + "]" * 150
    got = linked(frame, (1, 0, "assistant", f'<tool_call>{{"id": "x", "name": "add", "arguments": {{"a": 1, "b": {deep}}}}}</tool_call>'), (1, 1, "assistant", call("y", arguments={"a": 1, "b": "x" * 3_000_000})))
    assert {(r.call_id, r.status) for r in got} == {(None, "unreadable"), ("y", "unanswered")}


def test_repeated_rows_and_empty_table(frame):
    again = linked(frame, *[(1, 0, "assistant", call("x"))] * 3, *[(1, 1, "tool", result("x", 5))] * 2)
    assert [r.status for r in again] == ["linked"]
    assert linked(frame, (1, 0, "user", "x")) == []
    assert tc.link(frame([(1, 0, "a", "b", "c", 1)], MESSAGES).limit(0), SCHEMAS).count() == 0


JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**60), 2**60) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"])), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"])), x, max_size=4))


@given(JSON)
def test_canonical_round_trip(value):
    text = tc.canonical(tc.parse(json.dumps(value)))
    assert tc.parse(text) == tc.parse(json.dumps(value))
    assert tc.canonical(tc.parse(text)) == text


def test_canonical_form():
    assert tc.canonical(tc.parse('{"\\ud83d\\ude00":1,"\\uffee":1.0,"a":1e3,"b":1e-7,"c":"\\u0007\\n/"}')) == '{"a":1000,"b":1e-7,"c":"\\u0007\\n/","😀":1,"￮":1}'
    for bad in ('{"a":NaN}', "[1e999]", '"\\ud800"', "{", "[" * 200_000):
        with pytest.raises(tc.BadJson):
            tc.canonical(tc.parse(bad))


def test_schema_rules():
    s = {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1, "maximum": 3}, "s": {"type": ["string", "null"], "minLength": 2, "pattern": "^a"}, "l": {"type": "array", "items": {"enum": [1, 2]}, "maxItems": 2}}, "additionalProperties": {"type": "boolean"}}
    assert tc.violations({"n": 2, "s": "ab", "l": [1], "x": True}, s) == []
    assert tc.violations({"n": True, "s": "b", "l": [1, 3, 1], "x": 1}, s) == ["/n: type", "/s: limits", "/s: pattern", "/l/1: enum", "/l: limits", "/x: type"]
    assert tc.violations({"n": 4, "s": None}, s) == ["/n: limits"] and tc.violations([], s) == ["/: type"]
