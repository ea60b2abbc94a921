"""Conversations as canonical JSON with linked, ordered and validated tool calls.

A turn is a message; an assistant turn whose text is a JSON object with ``tool_calls`` also makes calls
({"id", "name", "arguments"}), and a turn of role tool is the result of the call that its ``tool_call_id``
names. Calls and results meet in a hash join on (conversation, identifier). A call may use results of other
calls ({"$ref": identifier} anywhere in its arguments); such calls are ordered topologically, and every
result follows its call. Arguments are validated against the tools' schemas; a reference fits any schema. Each
item becomes one row with canonical JSON: sorted keys, no spaces, characters as they are.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from fractions import Fraction
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, bound_batches
from .skew import HOT_PARTS, in_order, running_total, salted_join

ROLES = {"system", "user", "assistant", "tool"}
#: Levels of nesting up to which JSON is read; deeper items are malformed.
MOST_DEPTH = 100
#: References between the calls of a conversation up to which one task orders them; more are ordered in rounds.
MOST_GROUPED = 100_000
#: Types of JSON Schema.
TYPES = {
    "object": lambda x: isinstance(x, dict), "array": lambda x: isinstance(x, list), "string": lambda x: isinstance(x, str), "null": lambda x: x is None, "boolean": lambda x: isinstance(x, bool),
    "number": lambda x: _is_number(x), "integer": lambda x: _is_number(x) and (isinstance(x, int) or x.is_integer()),
}
#: Keywords of JSON Schema that say nothing about validity.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "readOnly", "writeOnly", "format"}


class Unsupported(ValueError):
    """A schema with a keyword or type that isn't known here."""


class BeyondJson(ValueError):
    """An object that Python reads but that isn't JSON for everyone: NaN, numbers beyond doubles, halves of surrogate pairs, too deep."""


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _same(a, b) -> bool:
    """Equality of JSON values: 1 equals 1.0, but not true."""
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return isinstance(a, bool) == isinstance(b, bool) and a == b


def _is_reference(value) -> bool:
    return isinstance(value, dict) and set(value) == {"$ref"} and isinstance(value["$ref"], str)


def _matches(pattern: str, text: str) -> bool:
    try:
        return re.search(pattern, text) is not None
    except re.error as e:
        raise Unsupported(pattern) from e


#: Keyword: (type of the values that it is about, whether a value passes).
CHECKS = {
    "minimum": ("number", lambda x, s: x >= s), "maximum": ("number", lambda x, s: x <= s), "exclusiveMinimum": ("number", lambda x, s: x > s), "exclusiveMaximum": ("number", lambda x, s: x < s),
    "multipleOf": ("number", lambda x, s: Fraction(str(x)) % Fraction(str(s)) == 0),
    "minLength": ("string", lambda x, s: len(x) >= s), "maxLength": ("string", lambda x, s: len(x) <= s), "pattern": ("string", lambda x, s: _matches(s, x)),
    "minItems": ("array", lambda x, s: len(x) >= s), "maxItems": ("array", lambda x, s: len(x) <= s), "items": ("array", lambda x, s: all(valid(y, s) for y in x)),
    "contains": ("array", lambda x, s: any(valid(y, s) for y in x)), "uniqueItems": ("array", lambda x, s: not s or not any(_same(a, b) for i, a in enumerate(x) for b in x[:i])),
    "minProperties": ("object", lambda x, s: len(x) >= s), "maxProperties": ("object", lambda x, s: len(x) <= s), "required": ("object", lambda x, s: all(k in x for k in s)),
    "properties": ("object", lambda x, s: all(valid(x[k], y) for k, y in s.items() if k in x)), "propertyNames": ("object", lambda x, s: all(valid(k, s) for k in x)),
    "enum": (None, lambda x, s: any(_same(x, y) for y in s)), "const": (None, _same), "not": (None, lambda x, s: not valid(x, s)),
    "allOf": (None, lambda x, s: all([valid(x, y) for y in s])), "anyOf": (None, lambda x, s: any([valid(x, y) for y in s])), "oneOf": (None, lambda x, s: sum([valid(x, y) for y in s]) == 1),
}


def valid(value, schema) -> bool:
    """Whether a value follows a schema; Unsupported if the schema has what isn't in TYPES, CHECKS, NOTES or ``additionalProperties``."""
    if isinstance(schema, bool):
        return schema
    if not isinstance(schema, dict):
        raise Unsupported(str(schema))
    kinds = schema.get("type", [])
    kinds = kinds if isinstance(kinds, list) else [kinds]
    strange = [k for k in schema if k not in CHECKS and k not in NOTES and k not in ("type", "additionalProperties")] + [k for k in kinds if not isinstance(k, str) or k not in TYPES]
    if strange:
        raise Unsupported(str(strange))
    if _is_reference(value):
        return True
    good = not kinds or any(TYPES[k](value) for k in kinds)
    for keyword, (kind, passes) in CHECKS.items():
        if good and keyword in schema and (kind is None or TYPES[kind](value)):
            good = passes(value, schema[keyword])
    if good and isinstance(value, dict) and "additionalProperties" in schema:
        good = all(valid(v, schema["additionalProperties"]) for k, v in value.items() if k not in schema.get("properties", {}))
    return good


def _references(value) -> list[str]:
    if _is_reference(value):
        return [value["$ref"]]
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return [r for v in parts for r in _references(v)]


def _constant(name: str):
    raise BeyondJson(name)


def _finite(text: str) -> float:
    number = float(text)
    if math.isinf(number):
        raise BeyondJson(text)
    return number


def _object(text: str | None) -> dict | None:
    """The JSON object that a text is, None if it is none; BeyondJson if not everyone can read it."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = json.loads(text, parse_constant=_constant, parse_float=_finite)
    except RecursionError as e:
        raise BeyondJson("depth") from e
    except BeyondJson:
        raise
    except ValueError:
        return None
    level, depth = [found], 0
    while level:
        depth += 1
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if depth > MOST_DEPTH:
            raise BeyondJson("depth")
    try:
        canonical(found).encode()
    except (UnicodeEncodeError, ValueError) as e:
        raise BeyondJson("characters or numbers") from e
    return found


def _items(role: str | None, text: str | None, schemas: dict) -> list[tuple]:
    """(kind, call_id, needs, status, message) of each item of a turn."""
    try:
        read, status = _object(text) if role in ("assistant", "tool") else None, "ok"
    except BeyondJson:
        read, status = None, "malformed"
    if role == "tool":
        call_id = read.get("tool_call_id") if read else None
        if not isinstance(call_id, str):
            return [("result", None, [], "malformed", canonical({"content": text, "role": role}))]
        return [("result", call_id, [], "ok", canonical({"content": read.get("content"), "role": role, "tool_call_id": call_id}))]
    calls = read.get("tool_calls") if read else None
    if not isinstance(calls, list):
        return [("message", None, [], status if role in ROLES else "malformed", canonical({"content": text, "role": role}))]
    out = [("message", None, [], "ok", canonical({"content": read.get("content"), "role": role}))]
    for call in calls:
        if not isinstance(call, dict) or not isinstance(call.get("id"), str) or not isinstance(call.get("name"), str) or not isinstance(call.get("arguments"), dict):
            out.append(("call", None, [], "malformed", canonical(call)))
            continue
        arguments, name = call["arguments"], call["name"]
        status = "unknown_tool" if schemas and name not in schemas else "ok"
        if name in schemas:
            try:
                status = "ok" if valid(arguments, schemas[name]) else "invalid_arguments"
            except (Unsupported, TypeError, ArithmeticError):
                status = "unsupported_schema"
        out.append(("call", call["id"], sorted(set(_references(arguments))), status, canonical({"arguments": arguments, "id": call["id"], "name": name, "type": "tool_call"})))
    return out


def _parse(batches: Iterator[pa.RecordBatch], schemas: dict) -> Iterator[pa.RecordBatch]:
    names = ["place", "kind", "call_id", "needs", "status", "message"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
    for batch in batches:
        rows, take = [], []
        for i, (role, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            found = _items(role, text, schemas)
            rows += [(place, *item) for place, item in enumerate(found)]
            take += [i] * len(found)
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([c.take(pa.array(take, pa.int64())) for c in batch.columns[:3]] + columns, ["conv", "turn", "role", *names])


def _kahn(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """(conv, call_id, after, depth) of a conversation's calls that use others, by Kahn's algorithm; those on or behind a cycle stay out."""
    rows = table.to_pylist()
    wants, users, turns = {}, {}, {}
    for r in rows:
        wants[r["call_id"]] = wants.get(r["call_id"], 0) + 1
        users.setdefault(r["need"], []).append(r["call_id"])
        turns[r["call_id"]], turns[r["need"]] = r["turn"], r["need_turn"]
    first = lambda x: (x is not None, x)
    placed = {c: (t, 0) for c, t in turns.items() if c not in wants}
    todo, made = list(placed), {}
    while todo:
        call = todo.pop()
        for user in users.get(call, ()):
            last, deep = made.get(user, (turns[user], 0))
            made[user] = (max(last, placed[call][0], key=first), max(deep, placed[call][1] + 1))
            wants[user] -= 1
            if not wants[user]:
                placed[user] = made[user]
                todo.append(user)
    out = [(rows[0]["conv"], c, *placed[c]) for c in wants if c in placed]
    return pa.table([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def _order(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, call_id, after, depth) of the calls that use others: the turn they can stand at and their rank there.

    ``edges`` has conv, call_id, need, turn and need_turn. A conversation is ordered in one task up to
    MOST_GROUPED edges, else in rounds of Kahn's algorithm that touch only what the round before has placed, one
    for each link of the longest chain. Calls on or behind a cycle stay out.
    """
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema.fields}
    out = f"conv {kinds['conv']}, call_id string, after {kinds['turn']}, depth int"
    large = edges.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_GROUPED).select(F.col("conv").alias("_conv"))
    on = F.col("conv").eqNullSafe(F.col("_conv"))
    empty = edges.sparkSession.createDataFrame([], out)
    schema = pa.schema([(f.name, t) for f, t in zip(empty.schema.fields, [f.type for f in empty.toArrow().schema], strict=True)])
    small = edges.join(large, on, "left_anti").groupBy("conv").applyInArrow(lambda table: _kahn(table, schema), out)
    if large.isEmpty():
        return small
    edges = scratch.table(edges.join(large, on, "left_semi"))
    pending = scratch.table(edges.groupBy("conv", "call_id").agg(F.first("turn").alias("last"), F.count(F.lit(1)).alias("wants"), F.lit(0).alias("depth")))
    named = lambda df: df.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_call"), *[F.col(c).alias(f"_{c}") for c in df.columns if c not in ("conv", "call_id")])
    same = on & (F.col("call_id") == F.col("_call"))
    free = edges.select("conv", F.col("need").alias("call_id"), F.col("need_turn").alias("after"), F.lit(0).alias("depth")).distinct()
    front = scratch.table(free.join(named(pending.select("conv", "call_id")), same, "left_anti"))
    placed = []
    while not front.isEmpty():
        using = edges.select("conv", F.col("call_id").alias("user"), F.col("need").alias("call_id")).join(named(front), same)
        met = using.groupBy("conv", F.col("user").alias("call_id")).agg(F.count(F.lit(1)).alias("met"), F.max("_after").alias("after"), F.max("_depth").alias("depth"))
        now = pending.join(named(met), same, "left").select("conv", "call_id", F.greatest("last", "_after").alias("last"), (F.col("wants") - F.coalesce("_met", F.lit(0))).alias("wants"), F.greatest(F.col("depth"), F.col("_depth") + 1).alias("depth"))
        now = scratch.table(now)
        front = scratch.table(now.where("wants = 0").select("conv", "call_id", F.col("last").alias("after"), "depth"))
        placed.append(front)
        before, pending = pending, scratch.table(now.where("wants > 0"))
        scratch.drop(before)
        scratch.drop(now)
    for part in placed:
        small = small.unionByName(part.withColumn("depth", F.col("depth").cast("int")))
    return small


def format_chats(turns: DataFrame, schemas: dict | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """A row for every message, call and result: ``conv_col``, seq, role, kind, call_id, status, message.

    seq numbers a conversation's items in topological order. Status: ok; malformed (an unreadable call or
    result, an unknown role); duplicate (an identifier that an earlier item of its kind has); orphan (a
    result without call); unanswered (a call without result); invalid_arguments; unsupported_schema (one with
    keywords that :func:`valid` doesn't know); unknown_tool (only with schemas); unmet (a call that refers to no
    call); cycle (a call on or behind one). Defined cases: null text is null content; a null role is malformed,
    and so is JSON that isn't JSON for everyone (NaN, numbers beyond doubles, halves of surrogate pairs, over
    MOST_DEPTH levels), whose text is kept as content; null conversations are one conversation; a null turn comes
    first; turns that repeat are all kept, in order of their JSON; an empty table gives an empty result; extra
    columns are ignored; a conversation may hold any share of the rows.
    """
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark)
    bound_batches(spark)
    conv_type, turn_type = (turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col))
    plain = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    schema = f"conv {conv_type}, turn {turn_type}, role string, place int, kind string, call_id string, needs array<string>, status string, message string"
    items = scratch.table(plain.mapInArrow(partial(_parse, schemas=schemas or {}), schema).withColumn("row", F.monotonically_increasing_id()))

    linked = items.where(F.col("call_id").isNotNull())
    if linked.isEmpty():
        placed = items.select("*", F.col("turn").alias("after"), F.lit(0).alias("depth"), F.lit(0).alias("step"), F.col("place").alias("at"))
        return _numbered(placed, items, conv_col, scratch)

    # calls and results of an identifier, one row each, meet in a hash join
    first = F.min(F.struct("turn", "place", "row")).alias("first")
    calls = linked.where("kind = 'call'").groupBy("conv", "call_id").agg(first, F.count(F.lit(1)).alias("n_calls"), F.min_by("needs", F.struct("turn", "place", "row")).alias("needs"))
    results = linked.where("kind = 'result'").groupBy("conv", "call_id").agg(F.min(F.struct("turn", "place", "row")).alias("first_result"), F.count(F.lit(1)).alias("n_results"))
    renamed = results.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_call"), "first_result", "n_results")
    pairs = calls.join(renamed.hint("shuffle_hash"), F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call")), "full")
    pairs = pairs.withColumns({"conv": F.coalesce("conv", "_conv"), "call_id": F.coalesce("call_id", "_call"), "n": F.coalesce("n_calls", F.lit(0)) + F.coalesce("n_results", F.lit(0))}).drop("_conv", "_call")
    pairs = scratch.table(pairs)

    wants = scratch.table(pairs.where(F.col("first").isNotNull()).select("conv", "call_id", F.col("first.turn").alias("turn"), F.explode("needs").alias("need")))
    known = pairs.where(F.col("first").isNotNull()).select(F.col("conv").alias("_conv"), F.col("call_id").alias("_call"), F.col("first.turn").alias("need_turn"))
    met = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("need") == F.col("_call"))
    edges = scratch.table(wants.join(known, met).select("conv", "call_id", "need", "turn", "need_turn"))
    unmet = wants.join(known, met, "left_anti").select(F.col("conv").alias("_conv"), F.col("call_id").alias("_call"), F.lit(True).alias("unmet")).distinct()
    using = edges.select(F.col("conv").alias("_conv"), F.col("call_id").alias("_call"), F.lit(True).alias("using")).distinct()
    order = _order(edges, scratch).select(F.col("conv").alias("_conv"), F.col("call_id").alias("_call"), F.struct("after", "depth").alias("order"))
    on = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("call_id") == F.col("_call"))
    full = pairs.drop("needs")
    for more in (order, using, unmet):
        full = full.join(more, on, "left").drop("_conv", "_call")

    keyed = salted_join(linked, full, ["conv", "call_id"], "n", linked.count(), F.col("row"))
    earliest = F.when(F.col("kind") == "call", F.col("first.row")).otherwise(F.col("first_result.row"))
    status = (
        F.when(F.col("row") != earliest, "duplicate").when((F.col("kind") == "result") & F.col("first").isNull(), "orphan").when(F.col("status") != "ok", F.col("status"))
        .when((F.col("kind") == "call") & F.col("unmet"), "unmet").when((F.col("kind") == "call") & F.col("using") & F.col("order").isNull(), "cycle")
        .when((F.col("kind") == "call") & F.col("first_result").isNull(), "unanswered").otherwise("ok")
    )
    # a call and its results stand at the call's turn and place, results after it
    has_call = F.col("first").isNotNull()
    extra = {
        "status": status, "after": F.when(has_call & F.col("order").isNotNull(), F.col("order.after")).when(has_call, F.col("first.turn")).otherwise(F.col("turn")), "depth": F.coalesce("order.depth", F.lit(0)),
        "at": F.when(has_call, F.col("first.place")).otherwise(F.col("place")), "step": F.when(F.col("kind") == "result", 1).otherwise(0),
    }
    keyed = keyed.withColumns(extra)
    rest = items.where(F.col("call_id").isNull()).select("*", F.col("turn").alias("after"), F.lit(0).alias("depth"), F.lit(0).alias("step"), F.col("place").alias("at"))
    return _numbered(rest.unionByName(keyed.select(*rest.columns)), items, conv_col, scratch)


def _numbered(placed: DataFrame, items: DataFrame, conv_col: str, scratch: Scratch) -> DataFrame:
    """Items numbered by conversation; the rows of one with over 1/HOT_PARTS of all are dealt out by ranges of their order."""
    order = [F.col(c).asc_nulls_first() for c in ("after", "depth", "at", "step", "turn", "place", "message", "row")]
    cut = max(1000, items.count() // HOT_PARTS)
    hot = items.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cut).select(F.col("conv").alias("_conv"))
    on = F.col("conv").eqNullSafe(F.col("_conv"))
    none = hot.isEmpty()
    cold = placed if none else placed.join(F.broadcast(hot), on, "left_anti")
    numbered = cold.withColumn("seq", F.row_number().over(Window.partitionBy("conv").orderBy(*order)) - 1)
    if not none:
        dealt = scratch.table(in_order(placed.join(F.broadcast(hot), on, "left_semi"), [F.col("conv"), *order], "bucket"))
        numbered = numbered.unionByName(running_total(dealt, ["conv"], "bucket", order, F.lit(1), "seq").drop("bucket"))
    return numbered.select(F.col("conv").alias(conv_col), F.col("seq").cast("long").alias("seq"), "role", "kind", "call_id", "status", "message")


#: The table of conversations has messages only.
ORACLE = """
    select conv_id, row_number() over (partition by conv_id order by turn, role, text) - 1 as seq, role, 'message' as kind, null::varchar as call_id, 'ok' as status,
           '{"content":' || to_json(text) || ',"role":"' || role || '"}' as message
    from conversations"""
