"""Chat formatting with linked tool calls.

An assistant's text may hold ``<tool_call>{"id", "name", "arguments", "after"}</tool_call>``; a message of role ``tool``
is ``{"tool_call_id", "content"}``. Calls and results are linked by a hash join on conversation and identifier. Their order is
topological: a result comes after its call, a call after the results of the calls it names in ``after``. Arguments are
checked against a JSON schema by tool name: those of ``tools.json`` ({name: schema}) beside the tables if it is there,
else TOOLS. Each event leaves as canonical JSON: sorted keys, no white space, no escapes that aren't needed.

A conversation may hold a third of all rows, so none is ever gathered: each event carries its place, (conv_id, at, depth,
turn, pos), by which a range sort writes conversations in order.

Cases: a null text is an empty one; null conv_id, turn or role are kept, with null in the JSON. Text that is no valid JSON
between the marks stays text. A repeated call identifier belongs to the first call that has it, the others are
``duplicate``; a result without call is ``orphan``; calls in a circle of ``after`` are ``cyclic``, and keep the order of their
turns. Repeated rows give repeated events. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .memory import tidy
from .store import Scratch, small_batches

_CALL = re.compile(r"<tool_call>(.*?)</tool_call>", re.S)
EVENTS = "conv_id long, turn long, pos int, kind string, call_id string, after array<string>, error string, json string"
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}

_TEXT, _COUNT = {"type": "string"}, {"type": "integer", "minimum": 1}


def _tool(required: list[str], **properties: dict) -> dict:
    return {"type": "object", "properties": properties, "required": required, "additionalProperties": False}


#: Schemas of the arguments by tool name, for tables that come without a tools.json of their own.
TOOLS: dict[str, dict] = {
    "search": _tool(["query"], query=_TEXT, limit=_COUNT),
    "fetch": _tool(["url"], url=_TEXT),
    "calculate": _tool(["expression"], expression=_TEXT),
    "run_code": _tool(["code"], code=_TEXT, language={"type": "string", "enum": ["python", "javascript", "sql", "bash"]}),
    "read_file": _tool(["path"], path=_TEXT, offset={"type": "integer", "minimum": 0}, limit=_COUNT),
    "write_file": _tool(["path", "content"], path=_TEXT, content=_TEXT),
}


def tools(spark: SparkSession, folder: str) -> dict[str, dict]:
    """The schemas for the conversations of a folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/tools.json")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return TOOLS
    return json.loads(spark.read.text(path.toString(), wholetext=True).first()["value"])


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def check(value: object, schema: dict, path: str = "$") -> str | None:
    """The first offence against a schema: type, enum, required, properties, additionalProperties, items, minimum, maximum."""
    kind = schema.get("type")
    if kind:
        kinds = [kind] if isinstance(kind, str) else kind
        fits = any(isinstance(value, _TYPES[k]) and not (isinstance(value, bool) and k in ("integer", "number")) for k in kinds)
        if not fits:
            return f"{path}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{path}: not in enum"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"{path}: out of range"
    if isinstance(value, dict):
        known = schema.get("properties", {})
        for k in schema.get("required", []):
            if k not in value:
                return f"{path}.{k}: missing"
        for k in sorted(value):
            if k in known:
                if e := check(value[k], known[k], f"{path}.{k}"):
                    return e
            elif schema.get("additionalProperties", True) is False:
                return f"{path}.{k}: unknown"
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            if e := check(x, schema["items"], f"{path}[{i}]"):
                return e
    return None


def _object(text: str) -> dict | None:
    try:
        value = json.loads(text)
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def parse(role: str | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """kind, call_id, after, error, json of each event of a message."""
    text = text or ""
    if role == "tool" and (value := _object(text)) and isinstance(value.get("tool_call_id"), str):
        body = canonical({"content": value.get("content"), "role": "tool", "tool_call_id": value["tool_call_id"]})
        return [("result", value["tool_call_id"], None, None, body)]
    out, rest, at = [], [], 0
    for m in _CALL.finditer(text) if role == "assistant" else ():
        value = _object(m[1])
        if value is None or not isinstance(value.get("id"), str) or not isinstance(value.get("name"), str):
            continue
        rest.append(text[at : m.start()])
        at = m.end()
        arguments = value.get("arguments", {})
        schema = schemas.get(value["name"])
        error = f"unknown tool {value['name']}" if schema is None else check(arguments, schema)
        after = [x for x in value.get("after", []) if isinstance(x, str)] if isinstance(value.get("after", []), list) else []
        body = canonical({"role": "assistant", "tool_call": {"arguments": arguments, "id": value["id"], "name": value["name"]}})
        out.append(("call", value["id"], after, error, body))
    rest.append(text[at:])
    plain = "".join(rest)
    if plain.strip() or not out:
        out.insert(0, ("message", None, None, None, canonical({"content": plain, "role": role})))
    return out


def events(turns: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(conv, turn, i, *e) for i, e in enumerate(parse(role, text, schemas))]
            cols = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in EVENTS.split(", ")])

    small_batches(turns.sparkSession)
    return turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(run, EVENTS)


def link(turns: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """conv_id, at, depth, turn, pos, kind, call_id, status, json: an event a row. status: ``ok``, ``duplicate``, ``orphan``,
    ``unanswered``, ``cyclic`` or what is wrong with the arguments; null for a message."""
    scratch = Scratch(turns.sparkSession, "chat")
    found = scratch.write(events(turns, schemas or {}).withColumn("id", F.monotonically_increasing_id()), "events")
    key = ["conv_id", "call_id"]
    # a few rows for an identifier, whatever the size of its conversation
    tools = found.filter("kind <> 'message'")
    owner = tools.filter("kind = 'call'").withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("turn", "pos", "id")))
    owner = scratch.write(owner.select(*key, "id", "turn", "after", (F.col("n") > 1).alias("again")), "calls")
    first = owner.filter("not again").select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("id").alias("call"))
    results = tools.filter("kind = 'result'").select(*key, "id", "turn")
    linked = results.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("k")))
    linked = scratch.write(linked.select(F.col("call").alias("a"), F.col("id").alias("b"), *key), "linked")
    waits = owner.select("conv_id", "id", F.explode("after").alias("k")).join(linked.select(F.col("conv_id").alias("c"), F.col("call_id").alias("k"), F.col("b").alias("r")), "k")
    waits = waits.filter(F.col("conv_id").eqNullSafe(F.col("c"))).select(F.col("r").alias("a"), F.col("id").alias("b"))
    edges = scratch.write(linked.select("a", "b").union(waits).distinct(), "edges")
    nodes = tools.select("id", F.coalesce("turn", F.lit(-1)).alias("at"), F.lit(0).alias("depth"))
    # Kahn's levels: what waits for nothing is placed, then what waits for placed events only
    left, done, turn = edges, None, 0
    placed = scratch.write(nodes.join(edges.select(F.col("b").alias("id")).distinct(), "id", "left_anti"), "placed-0")
    while not left.isEmpty():
        turn += 1
        ready = left.groupBy("b").agg(F.count("*").alias("need")).join(left.join(placed.withColumnsRenamed({"id": "a", "at": "at_a", "depth": "depth_a"}), "a").groupBy("b").agg(F.count("*").alias("have"), F.max(F.struct("at_a", "depth_a")).alias("m")), "b").filter("need = have")
        new = ready.select(F.col("b").alias("id"), "m").join(nodes.select("id", "at"), "id")
        new = new.select("id", F.greatest("at", "m.at_a").alias("at"), F.when(F.col("at") > F.col("m.at_a"), 0).otherwise(F.col("m.depth_a") + 1).alias("depth"))
        new = scratch.write(new, f"new-{turn}")
        if new.isEmpty():
            break
        placed = scratch.write(placed.union(new), f"placed-{turn}")
        left = scratch.write(left.join(new.select(F.col("id").alias("b")), "b", "left_anti"), f"left-{turn}")
    rows = found.join(placed, "id", "left").join(owner.select("id", "again"), "id", "left")
    rows = rows.join(linked.select(F.col("b").alias("id"), F.lit(True).alias("has_call")).distinct(), "id", "left")
    rows = rows.join(linked.select(F.col("a").alias("id"), F.lit(True).alias("has_result")).distinct(), "id", "left")
    status = (
        F.when(F.col("kind") == "message", F.lit(None).cast("string"))
        .when(F.col("at").isNull(), "cyclic")
        .when((F.col("kind") == "result") & F.col("has_call").isNull(), "orphan")
        .when(F.col("again"), "duplicate")
        .when(F.col("error").isNotNull(), F.col("error"))
        .when((F.col("kind") == "call") & F.col("has_result").isNull(), "unanswered")
        .otherwise("ok")
    )
    at, depth = F.coalesce("at", F.col("turn")), F.coalesce("depth", F.lit(0))
    rows = rows.select("conv_id", at.alias("at"), depth.alias("depth"), "turn", "pos", "kind", "call_id", status.alias("status"), "json")
    return rows.orderBy("conv_id", "at", "depth", "turn", "pos")


#: DuckDB SQL for link() of conversations without tool calls.
ORACLE = """
SELECT conv_id, turn AS at, CAST(0 AS INTEGER) AS depth, turn, CAST(0 AS INTEGER) AS pos, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id,
    CAST(NULL AS VARCHAR) AS status, '{"content":' || CAST(to_json(coalesce(text, '')) AS VARCHAR) || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS json
FROM conversations"""


def rehearsal(turns: DataFrame) -> DataFrame:
    """Tool calls and results made from the places of turns, for a table that has none: each status comes up.

    A turn of an assistant becomes calls of ``search`` and most often a result, one of a user a result that nobody asked for.
    """
    k, t = "pmod(conv_id * 7 + turn, 8)", "cast(turn AS string)"
    arguments = f"CASE {k} WHEN 2 THEN concat('{{\"query\":\"q', {t}, '\",\"limit\":0}}') WHEN 4 THEN '{{}}' ELSE concat('{{\"query\":\"q', {t}, '\",\"limit\":2}}') END"
    after = f"CASE {k} WHEN 5 THEN concat('[\"c', {t}, '\"]') ELSE '[]' END"
    call = f"concat('<tool_call>{{\"id\":\"c', {t}, '\",\"name\":\"', CASE {k} WHEN 3 THEN 'nope' ELSE 'search' END, '\",\"after\":', {after}, ',\"arguments\":', {arguments}, '}}</tool_call>')"
    asked, said = turns.filter("role = 'assistant'"), turns.filter("role = 'user'")
    calls = asked.selectExpr("conv_id", "2 * turn AS turn", "role", f"repeat({call}, CASE {k} WHEN 6 THEN 2 ELSE 1 END) AS text")
    results = asked.filter(f"{k} NOT IN (1, 3, 4)").selectExpr("conv_id", f"2 * turn + CASE {k} WHEN 7 THEN -1 ELSE 1 END", "'tool'", f"concat('{{\"tool_call_id\":\"c', {t}, '\",\"content\":\"r', {t}, '\"}}')")
    orphans = said.selectExpr("conv_id", "2 * turn", "'tool'", f"concat('{{\"tool_call_id\":\"x', {t}, '\",\"content\":null}}')")
    return calls.union(results).union(orphans)


#: DuckDB SQL for link() of rehearsal() of the conversations.
REHEARSAL = """
WITH asked AS (SELECT conv_id, turn AS t, (conv_id * 7 + turn) % 8 AS k FROM conversations WHERE role = 'assistant'),
call AS (SELECT conv_id, 2 * t AS spot, 0 AS depth, 2 * t AS turn, unnest(range(CASE k WHEN 6 THEN 2 ELSE 1 END)) AS pos, 'call' AS kind, 'c' || t AS call_id, k, t FROM asked),
result AS (SELECT conv_id, 2 * t + CASE k WHEN 7 THEN 0 ELSE 1 END AS spot, CASE k WHEN 7 THEN 1 ELSE 0 END AS depth, 2 * t + CASE k WHEN 7 THEN -1 ELSE 1 END AS turn, k, t FROM asked WHERE k NOT IN (1, 3, 4)),
event AS (
    SELECT conv_id, spot, depth, turn, pos, kind, call_id,
        CASE WHEN k = 5 THEN 'cyclic' WHEN k = 6 AND pos = 1 THEN 'duplicate' WHEN k = 2 THEN '$.limit: out of range' WHEN k = 3 THEN 'unknown tool nope' WHEN k = 4 THEN '$.query: missing' WHEN k = 1 THEN 'unanswered' ELSE 'ok' END AS status,
        '{"role":"assistant","tool_call":{"arguments":' || CASE k WHEN 4 THEN '{}' ELSE '{"limit":' || CASE k WHEN 2 THEN 0 ELSE 2 END || ',"query":"q' || t || '"}' END || ',"id":"c' || t || '","name":"' || CASE k WHEN 3 THEN 'nope' ELSE 'search' END || '"}}' AS json
    FROM call
    UNION ALL SELECT conv_id, spot, depth, turn, 0, 'result', 'c' || t, CASE k WHEN 5 THEN 'cyclic' ELSE 'ok' END, '{"content":"r' || t || '","role":"tool","tool_call_id":"c' || t || '"}' FROM result
    UNION ALL SELECT conv_id, 2 * turn, 0, 2 * turn, 0, 'result', 'x' || turn, 'orphan', '{"content":null,"role":"tool","tool_call_id":"x' || turn || '"}' FROM conversations WHERE role = 'user')
SELECT conv_id, CAST(spot AS BIGINT) AS at, CAST(depth AS INTEGER) AS depth, CAST(turn AS BIGINT) AS turn, CAST(pos AS INTEGER) AS pos, kind, call_id, status, json FROM event"""
