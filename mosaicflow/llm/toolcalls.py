"""Tool calls in conversations: linked with their results, ordered, validated and serialised as canonical JSON."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, written

CALL_TAG = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
RESULT_TAG = re.compile(r"<tool_response>(.*?)</tool_response>", re.S)
#: Values deeper than this are no arguments.
MOST_DEPTH = 100
#: Calls and references of one conversation that one task orders; larger conversations are ordered in rounds.
GROUP = 100_000


class BadJson(ValueError):
    """What can't be read as JSON, or not be written as canonical JSON."""


def _number(text: str) -> Any:
    value = float(text)
    if value != value or value in (float("inf"), float("-inf")):
        raise BadJson(f"number {text}")
    return int(value) if value.is_integer() and abs(value) < 1e21 else value


def parse(text: str) -> Any:
    """JSON as strict as RFC 8259; of repeated names the last holds, and whole numbers are integers however written."""

    def no(name: str):
        raise BadJson(name)

    try:
        return json.loads(text, parse_float=_number, parse_constant=no)
    except BadJson:
        raise
    except (ValueError, RecursionError) as e:
        raise BadJson(str(e)) from None


def canonical(value: Any, depth: int = 0) -> str:
    """One text for equal values: names sorted by UTF-16 code units, no white space, shortest numbers, only needed escapes."""
    if depth > MOST_DEPTH:
        raise BadJson("too deep")
    if isinstance(value, dict):
        names = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{canonical(k)}:{canonical(value[k], depth + 1)}" for k in names) + "}"
    if isinstance(value, list):
        return "[" + ",".join(canonical(x, depth + 1) for x in value) + "]"
    if isinstance(value, float):
        return re.sub(r"e([+-])0*(\d)", r"e\1\2", repr(value))
    if isinstance(value, str) and re.search("[\ud800-\udfff]", value):
        raise BadJson("lone surrogate")
    return json.dumps(value, ensure_ascii=False)


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _is(value: Any, kind: str) -> bool:
    if kind in ("integer", "number"):
        return isinstance(value, int if kind == "integer" else (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def violations(value: Any, schema: dict, at: str = "") -> list[str]:
    """Where a value breaks a JSON schema: type, enum, const, required, properties, additionalProperties, items and limits."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at or '/'}: type"]
    out = []
    if "enum" in schema and value not in schema["enum"] or "const" in schema and value != schema["const"]:
        out.append(f"{at or '/'}: enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}/{k}: required" for k in schema.get("required", ()) if k not in value]
        for k, x in value.items():
            if k in known:
                out += violations(x, known[k], f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}/{k}: unknown")
            elif isinstance(schema.get("additionalProperties"), dict):
                out += violations(x, schema["additionalProperties"], f"{at}/{k}")
    if isinstance(value, list):
        out += [y for i, x in enumerate(value) for y in violations(x, schema.get("items", {}), f"{at}/{i}")]
    size = len(value) if isinstance(value, (str, list)) else None
    for low, high, of in (("minimum", "maximum", value if _is(value, "number") else None), ("minLength", "maxLength", size if isinstance(value, str) else None), ("minItems", "maxItems", size if isinstance(value, list) else None)):
        if of is not None and (low in schema and of < schema[low] or high in schema and of > schema[high]):
            out.append(f"{at or '/'}: limits")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{at or '/'}: pattern")
    return out


def references(value: Any) -> list[str]:
    """Identifiers of calls whose results a value asks for, as {"$ref": identifier}, each once, in order."""
    found: dict[str, None] = {}

    def walk(x: Any) -> None:
        if isinstance(x, dict):
            if isinstance(x.get("$ref"), str):
                found[x["$ref"]] = None
            for y in x.values():
                walk(y)
        elif isinstance(x, list):
            for y in x:
                walk(y)

    walk(value)
    return list(found)


def _calls(text: str) -> Iterator[Any]:
    """Call objects of an assistant's text: tagged ones, or those of a message that is JSON with tool_calls."""
    if "<tool_call>" in text:
        for m in CALL_TAG.finditer(text):
            yield m[1]
    elif text.lstrip().startswith("{") and '"tool_calls"' in text:
        try:
            message = parse(text)
        except BadJson:
            return
        yield from message["tool_calls"] if isinstance(message.get("tool_calls"), list) else ()


def _read_call(raw: Any, schemas: dict[str, dict]) -> tuple:
    """(call_id, name, arguments as canonical JSON, references, errors) of one call."""
    try:
        call = parse(raw) if isinstance(raw, str) else raw
        if not isinstance(call, dict):
            raise BadJson("no object")
        own = call["function"] if isinstance(call.get("function"), dict) else call
        arguments = own.get("arguments", {})
        if isinstance(arguments, str):
            arguments = parse(arguments)
        call_id, name = call.get("id"), own.get("name")
        call_id = None if call_id is None else call_id if isinstance(call_id, str) else canonical(call_id)
        text = canonical(arguments)
        errors = ["id: required"] * (call_id is None)
        if not isinstance(name, str) or name not in schemas:
            errors.append("name: unknown")
        else:
            errors += violations(arguments, schemas[name])
        return call_id, name if isinstance(name, str) else None, text, references(arguments), errors
    except (BadJson, RecursionError) as e:
        return None, None, None, [], [f"json: {e}"]


def _read_results(text: str) -> Iterator[tuple]:
    """(call_id, content as canonical JSON, errors) of each result in a tool's text."""
    found = [m[1] for m in RESULT_TAG.finditer(text)] or [text]
    for raw in found:
        try:
            result = parse(raw)
            if not isinstance(result, dict):
                raise BadJson("no object")
            call_id = result.get("tool_call_id", result.get("id"))
            yield None if call_id is None else call_id if isinstance(call_id, str) else canonical(call_id), canonical(result.get("content")), ["id: required"] * (call_id is None)
        except (BadJson, RecursionError) as e:
            yield None, None, [f"json: {e}"]


EVENTS = "conv_id long, turn long, index int, kind string, call_id string, name string, body string, refs array<string>, errors array<string>"
_TYPES_OUT = [pa.int64(), pa.int64(), pa.int32(), *[pa.string()] * 4, *[pa.list_(pa.string())] * 2]
_NAMES = [x.split()[0] for x in EVENTS.split(", ")]


def events(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls of assistants and results of tools in messages, one row each, numbered from 0 in their message; no shuffle."""

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for conv, turn, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")), strict=True):
            if role == "assistant" and text:
                out += [(conv, turn, i, "call", *_read_call(raw, schemas)) for i, raw in enumerate(_calls(text))]
            elif role == "tool" and text:
                out += [(conv, turn, i, "result", call_id, None, body, [], errors) for i, (call_id, body, errors) in enumerate(_read_results(text))]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(_TYPES_OUT)], names=_NAMES)

    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, kernel, EVENTS)


def _hashed(build: DataFrame) -> DataFrame:
    """The side of a join that is hashed: rows of few columns, one a key."""
    return build.hint("shuffle_hash")


def levels_of(needs: dict[str, list[str]]) -> dict[str, int | None]:
    """Of calls with the calls they ask for: one more than the largest level asked for, 0 where none of them is asked for; None in and after a cycle."""
    open_ = {k: sum(r in needs for r in own) for k, own in needs.items()}
    asked: dict[str, list[str]] = {}
    for k, own in needs.items():
        for r in own:
            asked.setdefault(r, []).append(k)
    levels: dict[str, int | None] = dict.fromkeys(needs)
    ready, level = [k for k, n in open_.items() if not n], 0
    while ready:  # a call is ready in the round after the last one that it asks for
        following = []
        for k in ready:
            levels[k] = level
            for other in asked.get(k, ()):
                open_[other] -= 1
                if not open_[other]:
                    following.append(other)
        ready, level = following, level + 1
    return levels


def _levels_by_conversation(calls: DataFrame) -> DataFrame:
    """(key, level) of calls (conv, call_id, key, refs) of conversations of up to GROUP calls and references, whole in one task each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, keys, needs = None, {}, {}

        def found() -> pa.RecordBatch:
            levels = levels_of(needs)
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in levels], pa.string()), pa.array(list(levels.values()), pa.int32())], names=["key", "level"])

        for batch in batches:
            for c, call_id, key, refs in zip(*(batch.column(k).to_pylist() for k in ("conv", "call_id", "key", "refs")), strict=True):
                if c != conv and needs:
                    yield found()
                    keys, needs = {}, {}
                conv, keys[call_id], needs[call_id] = c, key, refs
        if needs:
            yield found()

    return calls.select("conv", "call_id", "key", "refs").repartition("conv").sortWithinPartitions("conv").mapInArrow(run, "key string, level int")


def _levels_by_rounds(calls: DataFrame) -> DataFrame:
    """(key, level) of calls of conversations of any size; calls in and after a cycle have no row.

    A row of the state is a bound of a call's level, or a call that it still waits for and how far above that it stands. Each round
    gives levels to calls that wait for none, and replaces waiting for a call that itself waits for one only by waiting for
    that one, so chains end after the logarithm of their length.
    """
    key = lambda c: F.concat("conv", F.lit("\x1f"), c)
    edges = calls.select("conv", "key", F.explode("refs").alias("ref")).select("key", key("ref").alias("needs"))
    edges = edges.join(_hashed(calls.select(F.col("key").alias("needs"))), "needs", "left_semi")
    state = calls.select("key", F.lit(None).cast("string").alias("needs"), F.lit(0).alias("above")).unionByName(edges.select("key", "needs", F.lit(1).alias("above")))
    state, done = written(state.distinct(), "call-state"), []
    while True:
        least = F.max(F.when(F.col("needs").isNull(), F.col("above")))
        calls_now = written(state.groupBy("key").agg(least.alias("bound"), F.count("needs").alias("open"), F.max("needs").alias("only"), F.max(F.when(F.col("needs").isNotNull(), F.col("above"))).alias("step")), "call-rounds")
        ready = calls_now.where("open = 0")
        if ready.isEmpty():
            discard(calls_now)
            break
        done.append(written(ready.select("key", F.col("bound").alias("level")), "call-levels"))
        # Of calls that wait for one that is ready now, the bound is known; they pass it on at once, as it leaves the state.
        settled = _hashed(ready.select(F.col("key").alias("only"), F.col("bound").alias("settled")))
        passed = calls_now.where("open <= 1").join(settled, "only", "left").select(
            F.col("key").alias("needs"), F.greatest("bound", F.col("step") + F.col("settled")).alias("bound"), F.when(F.col("settled").isNull(), F.col("open")).otherwise(0).alias("open"), "only", "step"
        )
        left = state.join(_hashed(ready.select("key")), "key", "left_anti").join(_hashed(passed), "needs", "left")
        nobody = F.lit(None).cast("string")
        rows = F.when(F.col("open").isNull(), F.array(F.struct("needs", "above"))).otherwise(
            F.filter(
                F.array(F.struct(nobody.alias("needs"), (F.col("above") + F.col("bound")).alias("above")), F.when(F.col("open") == 1, F.struct(F.col("only").alias("needs"), (F.col("above") + F.col("step")).alias("above")))),
                lambda x: x.isNotNull(),
            )
        )
        before, state = state, written(left.select("key", F.explode(rows).alias("r")).groupBy("key", F.col("r.needs").alias("needs")).agg(F.max("r.above").alias("above")), "call-state")
        discard(before)
        discard(calls_now)
    discard(state)
    return functools.reduce(DataFrame.unionByName, done) if done else calls.select("key", F.lit(0).alias("level")).limit(0)


def _levels(first: DataFrame, group: int) -> DataFrame:
    """(key, level) of calls in conversations where some call asks for another's result."""
    sizes = first.groupBy("conv").agg((F.count("*") + F.sum(F.size("refs"))).alias("size"), F.max(F.size("refs")).alias("most")).where("most > 0")
    calls = written(first.select("conv", "call_id", "key", "refs").join(_hashed(sizes.select("conv", "size")), "conv"), "ordered-calls")
    found = _levels_by_conversation(calls.where(F.col("size") <= group))
    large = calls.where(F.col("size") > group)
    if large.isEmpty():
        return found
    ranked = _levels_by_rounds(large)
    return found.unionByName(large.select("key").join(_hashed(ranked), "key", "left"))


def link(messages: DataFrame, schemas: dict[str, dict], group: int = GROUP) -> DataFrame:
    """One row for each call, and for each result without one.

    Columns: conv_id, call_id, name, call_turn, call_index, result_turn, result_index, status, level, errors, call_json. status is linked, unanswered
    (a call without result), orphan (a result without call), repeated_call or repeated_result (its identifier came before in
    the conversation), unreadable or cyclic. level is one more than the largest among the calls that a call asks for, 0 where it asks
    for none of its conversation, null in and after a cycle: sorting a conversation by level puts every call after those whose results it asks
    for. call_json is the canonical JSON of arguments, id, name and result. Messages of other roles, and null texts, hold no events; a null conv_id is a
    conversation of its own; rows that repeat give repeated calls and results, as far as their places differ, and are one where they don't.
    JSON of more than MOST_DEPTH levels is unreadable. Conversations may have any length: those of up to group calls and references are
    ordered in one task each, longer ones in rounds over tables.
    """
    found = events(messages, schemas).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    found = written(found.withColumn("key", F.concat("conv", F.lit("\x1f"), "call_id")).distinct(), "call-events")
    place = F.struct(F.coalesce("turn", F.lit(-1)), "index", F.coalesce("name", F.lit("")), F.coalesce("body", F.lit("")))
    least = found.where("key IS NOT NULL").groupBy(F.col("kind").alias("of"), F.col("key").alias("of_key")).agg(F.min(place).alias("least"))
    told = found.join(_hashed(least), (F.col("key") == F.col("of_key")) & (F.col("kind") == F.col("of")), "left")
    told = written(told.withColumn("is_first", F.coalesce(place == F.col("least"), F.lit(False))).drop("of", "of_key", "least"), "told-events")

    first = told.where("is_first AND kind = 'call'")
    levels = _levels(first, group).select(F.col("key").alias("level_key"), F.col("level").alias("found_level"), F.lit(True).alias("ordered"))
    calls = first.select("conv_id", "call_id", "key", "name", F.col("turn").alias("call_turn"), F.col("index").alias("call_index"), "body", "errors")
    calls = calls.join(_hashed(levels), F.col("key") == F.col("level_key"), "left").withColumn("level", F.when(F.col("ordered"), F.col("found_level")).otherwise(0))
    answers = told.where("is_first AND kind = 'result'").select(
        F.col("conv_id").alias("result_conv_id"), F.col("call_id").alias("result_id"), F.col("key").alias("result_key"), F.col("turn").alias("result_turn"), F.col("index").alias("result_index"), F.col("body").alias("result"), F.col("errors").alias("result_errors")
    )
    linked = calls.join(_hashed(answers), F.col("key") == F.col("result_key"), "full")
    is_call, has_result = F.col("key").isNotNull(), F.col("result_key").isNotNull()
    status = F.when(~is_call, "orphan").when(F.col("level").isNull(), "cyclic").when(has_result, "linked").otherwise("unanswered")
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    whole = F.concat(F.lit('{"arguments":'), "body", F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), F.coalesce(quoted("name"), F.lit("null")), F.lit(',"result":'), F.coalesce("result", F.lit("null")), F.lit("}"))
    ones = linked.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("result_conv_id")).alias("conv_id"), F.coalesce("call_id", "result_id").alias("call_id"), "name", "call_turn", "call_index", "result_turn", "result_index",
        status.alias("status"), F.when(is_call, F.col("level")).alias("level"), F.coalesce("errors", "result_errors").alias("errors"), F.when(is_call, whole).alias("call_json"),
    )
    a_call = F.col("kind") == "call"
    others = told.where("NOT is_first").select(
        "conv_id", "call_id", "name", F.when(a_call, F.col("turn")).alias("call_turn"), F.when(a_call, F.col("index")).alias("call_index"), F.when(~a_call, F.col("turn")).alias("result_turn"), F.when(~a_call, F.col("index")).alias("result_index"),
        F.when(F.col("call_id").isNull(), "unreadable").when(a_call, "repeated_call").otherwise("repeated_result").alias("status"), F.lit(None).cast("int").alias("level"), "errors", F.lit(None).cast("string").alias("call_json"),
    )
    return ones.unionByName(others)
