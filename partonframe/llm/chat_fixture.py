"""Conversations with tool calls: three kinds, one for every conversation of a table, and what formatting makes of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = {
    "sum": {"type": "object", "required": ["x", "y"], "properties": {"x": {"type": "integer", "minimum": 0}, "y": {"type": "integer"}}, "additionalProperties": False},
    "find": {"type": "object", "required": ["q"], "properties": {"q": {"type": "string", "minLength": 2}}},
    "odd": {"type": "object", "$dynamicRef": "#x"},
}


def _calls(*calls: tuple, content: str | None = None) -> str:
    made = [f'{{"id":{json.dumps(i)},"name":"{name}","arguments":{arguments}}}' for i, name, arguments in calls]
    return f'{{"content":{json.dumps(content)},"tool_calls":[{",".join(made)}]}}'


DEEP = '{"content":' + "[" * 200 + "]" * 200 + "}"
#: Turns (role, text) of each kind; {id} stands for the conversation's.
TURNS = [
    [
        ("user", "add {id}"), ("assistant", _calls(("b", "sum", '{"x":{"$ref":"a"},"y":{id}}'), ("a", "sum", '{"y":2,"x":1}'), content="working")), ("tool", '{"tool_call_id":"b","content":"late"}'),
        ("tool", '{"content":{"z":3,"y":[1,2.5]},"tool_call_id":"a"}'), ("tool", '{"tool_call_id":"a","content":4}'), ("tool", '{"tool_call_id":"zz"}'), ("user", "thanks"),
    ], [
        ("system", "tools"),
        ("assistant", _calls(("c1", "sum", '{"x":{"$ref":"c2"},"y":1}'), ("c2", "sum", '{"x":{"$ref":"c1"},"y":1}'), ("u", "sum", '{"x":{"$ref":"nobody"},"y":1}'), ("w", "sum", '{"x":-1,"y":"two"}'), ("n", "fly", "{}"), ("o", "odd", "{}"), ("p", "find", '{"q":"ab"}'), (7, "find", "{}"))),
        ("tool", '{"tool_call_id":"w","content":"?"}'),
    ], [
        ("robot", "x"), ("tool", "text"), ("assistant", r'{"content":"\ud800","tool_calls":[]}'), ("assistant", '{"content":1e999}'), ("assistant", '{"content":NaN}'), ("assistant", "{not json"),
        ("assistant", '{"content":"plain","tool_calls":[]}'), ("user", None), ("assistant", DEEP),
    ],
]
_call = '{{"arguments":{},"id":"{}","name":"{}","type":"tool_call"}}'.format
#: Rows (role, kind, call_id, status, message) in their order.
ROWS = [
    [
        ("user", "message", None, "ok", '{"content":"add {id}","role":"user"}'), ("assistant", "message", None, "ok", '{"content":"working","role":"assistant"}'),
        ("assistant", "call", "a", "ok", _call('{"x":1,"y":2}', "a", "sum")), ("tool", "result", "a", "ok", '{"content":{"y":[1,2.5],"z":3},"role":"tool","tool_call_id":"a"}'),
        ("tool", "result", "a", "duplicate", '{"content":4,"role":"tool","tool_call_id":"a"}'), ("assistant", "call", "b", "ok", _call('{"x":{"$ref":"a"},"y":{id}}', "b", "sum")),
        ("tool", "result", "b", "ok", '{"content":"late","role":"tool","tool_call_id":"b"}'), ("tool", "result", "zz", "orphan", '{"content":null,"role":"tool","tool_call_id":"zz"}'),
        ("user", "message", None, "ok", '{"content":"thanks","role":"user"}'),
    ], [
        ("system", "message", None, "ok", '{"content":"tools","role":"system"}'), ("assistant", "message", None, "ok", '{"content":null,"role":"assistant"}'),
        ("assistant", "call", "c1", "cycle", _call('{"x":{"$ref":"c2"},"y":1}', "c1", "sum")), ("assistant", "call", "c2", "cycle", _call('{"x":{"$ref":"c1"},"y":1}', "c2", "sum")),
        ("assistant", "call", "u", "unmet", _call('{"x":{"$ref":"nobody"},"y":1}', "u", "sum")), ("assistant", "call", "w", "invalid_arguments", _call('{"x":-1,"y":"two"}', "w", "sum")),
        ("tool", "result", "w", "ok", '{"content":"?","role":"tool","tool_call_id":"w"}'), ("assistant", "call", "n", "unknown_tool", _call("{}", "n", "fly")),
        ("assistant", "call", "o", "unsupported_schema", _call("{}", "o", "odd")), ("assistant", "call", "p", "unanswered", _call('{"q":"ab"}', "p", "find")),
        ("assistant", "call", None, "malformed", '{"arguments":{},"id":7,"name":"find"}'),
    ], [
        ("robot", "message", None, "malformed", '{"content":"x","role":"robot"}'), ("tool", "result", None, "malformed", '{"content":"text","role":"tool"}'),
        ("assistant", "message", None, "malformed", r'{"content":"{\"content\":\"\\ud800\",\"tool_calls\":[]}","role":"assistant"}'), ("assistant", "message", None, "malformed", r'{"content":"{\"content\":1e999}","role":"assistant"}'),
        ("assistant", "message", None, "malformed", r'{"content":"{\"content\":NaN}","role":"assistant"}'), ("assistant", "message", None, "ok", '{"content":"{not json","role":"assistant"}'),
        ("assistant", "message", None, "ok", '{"content":"plain","role":"assistant"}'), ("user", "message", None, "ok", '{"content":null,"role":"user"}'),
        ("assistant", "message", None, "malformed", json.dumps({"content": DEEP, "role": "assistant"}, separators=(",", ":"))),
    ],
]


def tool_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: a conversation with tool calls for every one of the table, its kind by the id."""
    kinds = [(k, turn, role, text) for k, turns in enumerate(TURNS) for turn, (role, text) in enumerate(turns)]
    turns = conversations.sparkSession.createDataFrame(kinds, "kind int, turn long, role string, text string")
    ids = conversations.select("conv_id", F.pmod("conv_id", F.lit(len(TURNS))).cast("int").alias("kind")).distinct()
    return ids.join(F.broadcast(turns), "kind").select("conv_id", "turn", "role", F.replace("text", F.lit("{id}"), F.col("conv_id").cast("string")).alias("text"))


def _quoted(x: object) -> str:
    return "null" if x is None else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


_VALUES = ", ".join(f"({', '.join(map(_quoted, (k, seq, *row)))})" for k, rows in enumerate(ROWS) for seq, row in enumerate(rows))
ORACLE = f"""
    select conv_id, seq::bigint as seq, role, v.kind, call_id, status, replace(message, '{{id}}', conv_id::varchar) as message
    from (select distinct conv_id from conversations) c join (values {_VALUES}) v(k, seq, role, kind, call_id, status, message) on c.conv_id % {len(ROWS)} = v.k"""
