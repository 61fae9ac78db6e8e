"""Tool-call linking for chat formatting.

Calls and results are hash-joined by conversation and identifier, calls are
ordered topologically by the references in their arguments, the arguments are
validated against their tool's schema, and messages are serialised as
canonical JSON (sorted keys, no blanks, shortest numbers).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefloom.llm.common import written

MAX_SCHEMA_BYTES = 16 << 20
REFERENCE = "$ref"


# --- canonical JSON and schema checks (per value) -----------------------------------


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def parse_json(text: str):
    """The value, or ValueError: NaN, infinities and repeated keys are errors, and so is nesting that the parser cannot follow."""
    sys.set_int_max_str_digits(0)  # integers of any length
    try:
        return json.loads(text, object_pairs_hook=_unique, parse_constant=_no_constant)
    except RecursionError as e:
        raise ValueError("nested too deeply") from e


LONE = re.compile("[\ud800-\udfff]")


def encodable(text: str) -> str:
    """Lone surrogates, which JSON can name but UTF-8 cannot hold, as their escapes."""
    return LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


class _Text(str):
    """Text that is written as it is."""


def canonical(value) -> str:
    """JSON with keys sorted by code point, no blanks, integral floats as integers and lone surrogates escaped."""
    sys.set_int_max_str_digits(0)
    out, stack = [], [value]  # a stack of its own: nesting may be deep
    while stack:
        x = stack.pop()
        if isinstance(x, _Text):
            out.append(x)
        elif isinstance(x, dict):
            parts = [_Text("{")]
            for i, k in enumerate(sorted(x)):
                parts += [_Text("," * (i > 0) + json.dumps(k, ensure_ascii=False) + ":"), x[k]]
            stack += reversed([*parts, _Text("}")])
        elif isinstance(x, list):
            parts = [_Text("[")]
            for i, v in enumerate(x):
                parts += [_Text(",")] * (i > 0) + [v]
            stack += reversed([*parts, _Text("]")])
        else:
            if isinstance(x, float):
                if x != x or x in (float("inf"), float("-inf")):
                    raise ValueError("number out of range")
                if x == int(x) and abs(x) < 1e15:
                    x = int(x)
            out.append(json.dumps(x, ensure_ascii=False))
    return encodable("".join(out))


TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: not isinstance(v, bool) and (isinstance(v, int) or isinstance(v, float) and v == int(v)),
    "number": lambda v: not isinstance(v, bool) and isinstance(v, int | float),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}


def violations(value, schema: dict, path: str = "$") -> list[str]:
    """What a value breaks of a schema: type, enum, required, properties, additionalProperties, items, bounds.

    A reference {"$ref": id} stands for another call's result and fits any type.
    """
    out, stack = [], [(value, schema, path)]
    while stack:
        value, schema, path = stack.pop()
        found, parts = _breaks(value, schema, path)
        out += found
        stack += reversed(parts)
    return out


def _breaks(value, schema: dict, path: str) -> tuple[list[str], list[tuple]]:
    """What a value itself breaks, and its parts with their schemas and paths."""
    if isinstance(value, dict) and set(value) == {REFERENCE} and isinstance(value[REFERENCE], str):
        return [], []
    kind = schema.get("type")
    if kind and not any(TYPES[k](value) for k in ([kind] if isinstance(kind, str) else kind)):
        return [f"{path}: not {kind if isinstance(kind, str) else ' or '.join(kind)}"], []
    out, parts = [], []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{path}: not in enum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{path}.{encodable(k)}: unknown" for k in sorted(value) if k not in known]
        parts = [(value[k], known[k], f"{path}.{k}") for k in sorted(value) if k in known]
    elif isinstance(value, list) and "items" in schema:
        parts = [(v, schema["items"], f"{path}[{i}]") for i, v in enumerate(value)]
    elif isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{path}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: too long")
    elif isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{path}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{path}: above maximum")
    return out, parts


def references(value) -> list[str]:
    """Call ids that the arguments refer to, without repeats, in order."""
    out: dict[str, None] = {}
    stack = [value]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            if set(x) == {REFERENCE} and isinstance(x[REFERENCE], str):
                out[encodable(x[REFERENCE])] = None
            else:
                stack.extend(reversed(list(x.values())))
        elif isinstance(x, list):
            stack.extend(reversed(x))
    return list(out)


def _checker(schemas: dict[str, dict]):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            canon, errors, refs = [], [], []
            for name, args in zip(batch.column("name").to_pylist(), batch.column("arguments").to_pylist(), strict=True):
                text, wrong, to = None, [], []
                try:
                    value = parse_json(args if args is not None else "")
                    text, to = canonical(value), references(value)
                    if name not in schemas:
                        wrong = ["unknown tool"]
                    else:
                        wrong = violations(value, schemas[name])
                except (ValueError, OverflowError):
                    wrong = ["not JSON"]
                canon.append(text)
                errors.append("; ".join(wrong))
                refs.append(to)
            cols = {f: batch.column(f) for f in batch.schema.names if f != "arguments"}
            cols |= {"arguments": pa.array(canon, pa.string()), "error": pa.array(errors, pa.string()), "refs": pa.array(refs, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return check


# --- the Spark side ------------------------------------------------------------------


def _levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level: the longest chain of references below a call.

    Layer by layer: a call is placed when all calls that it refers to are.
    References to unknown calls do not count; calls in or behind a cycle get
    no level.  One join per layer, so the rounds are as many as the longest chain.
    """
    nodes = calls.select("conv_id", "call_id")
    edges = calls.select("conv_id", "call_id", F.explode("refs").alias("to"))
    known = nodes.select("conv_id", F.col("call_id").alias("to"))
    edges = written(edges.join(known, ["conv_id", "to"], "left_semi"), "call-references")
    open_ = written(edges.select("conv_id", "call_id").distinct(), "open-calls")
    placed = [nodes.join(open_, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0))]
    level = 0
    while not edges.isEmpty():
        blocked = open_.select("conv_id", F.col("call_id").alias("to"))
        edges = edges.join(blocked, ["conv_id", "to"], "left_semi")
        edges = written(edges, "call-references")
        still = written(edges.select("conv_id", "call_id").distinct(), "open-calls")
        level += 1
        ready = written(open_.join(still, ["conv_id", "call_id"], "left_anti"), "ready-calls")
        if ready.isEmpty():
            break  # what is left is in a cycle or waits for one
        placed.append(ready.withColumn("level", F.lit(level)))
        open_ = still
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per result without a call, in formatting order.

    calls: conv_id, turn, call_id, name, arguments (JSON text).
    results: conv_id, turn, call_id, content.

    Returns conv_id, seq (from 0 in each conversation), kind ("call" or
    "orphan"), call_id, name, level, valid, error, message (canonical JSON of
    the call and its result, or of the orphan).  Order: level, then turn, then
    call id; calls in cycles after the rest, orphans last.  Of calls that
    share an id in a conversation the first by turn stays, then by name and
    arguments; so does the first result by turn and content; further ones are
    orphans.  A null conversation or call id matches nothing: such calls are
    dropped as nameless, such results are orphans.  Schemas are checked to be
    below 16 MB before they are sent to the tasks.
    """
    if len(json.dumps(schemas)) > MAX_SCHEMA_BYTES:
        raise ValueError("the schemas are larger than 16 MB")
    key = ["conv_id", "call_id"]
    calls = calls.select("conv_id", "turn", "call_id", "name", "arguments").filter("conv_id is not null and call_id is not null")
    # the least row of an id by partial aggregation: a hot id needs no window
    calls = calls.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments")).alias("c")).select(*key, "c.turn", "c.name", "c.arguments")
    types = {f.name: f.dataType.simpleString() for f in calls.schema.fields}
    schema = f"conv_id {types['conv_id']}, call_id {types['call_id']}, turn {types['turn']}, name string, arguments string, error string, refs array<string>"
    calls = written(calls.mapInArrow(_checker(schemas), schema), "calls")
    results = results.select("conv_id", F.col("turn").alias("r_turn"), "call_id", "content")
    results = written(results.withColumn("row", F.monotonically_increasing_id()), "results")
    first = results.filter("conv_id is not null and call_id is not null").groupBy(*key).agg(F.min(F.struct("r_turn", "content", "row")).alias("r"))
    linked = calls.join(first, key, "left").join(_levels(calls), key, "left")
    linked = written(linked.withColumn("linked", F.col("r").isNotNull()), "linked-calls")
    used = linked.filter("linked").select(F.col("r.row").alias("row"))
    orphans = results.join(used, "row", "left_anti")
    rows = linked.select(
        "conv_id", F.lit("call").alias("kind"), F.col("call_id").cast("string").alias("call_id"), "name", "level", "error", "linked", "arguments",
        F.col("r.content").alias("content"), F.when(F.col("level").isNull(), 1).otherwise(0).alias("o1"), F.col("turn").alias("o2"), F.lit(0).cast("long").alias("o3"),
    )
    none = F.lit(None).cast("string")
    rows = rows.unionByName(
        orphans.select(
            "conv_id", F.lit("orphan").alias("kind"), F.col("call_id").cast("string").alias("call_id"), none.alias("name"), F.lit(None).cast("int").alias("level"),
            F.lit("no call").alias("error"), F.lit(False).alias("linked"), none.alias("arguments"), "content", F.lit(2).alias("o1"), F.col("r_turn").alias("o2"), F.col("row").alias("o3"),
        )
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("o1", F.coalesce("level", F.lit(0)), "o2", "call_id", "content", "o3")) - 1
    rows = rows.withColumn("seq", place.cast("long")).drop("o1", "o2", "o3")
    schema = f"conv_id {types['conv_id']}, seq long, kind string, call_id string, name string, level int, valid boolean, linked boolean, error string, message string"
    return rows.mapInArrow(_serialised, schema)


def _serialised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        valid, messages = [], []
        for kind, call_id, name, error, args, content in zip(
            *(batch.column(c).to_pylist() for c in ("kind", "call_id", "name", "error", "arguments", "content")), strict=True
        ):
            valid.append(error == "")
            m = {"id": call_id, "result": content}
            if kind == "call":
                m |= {"name": name, "arguments": None if args is None else json.loads(args), "valid": error == ""}
            messages.append(canonical(m))
        cols = [batch.column(c) for c in ("conv_id", "seq", "kind", "call_id", "name", "level")]
        cols += [pa.array(valid, pa.bool_()), batch.column("linked"), batch.column("error"), pa.array(messages, pa.string())]
        yield pa.RecordBatch.from_arrays(
            cols, names=["conv_id", "seq", "kind", "call_id", "name", "level", "valid", "linked", "error", "message"]
        )


# --- calls and results derived from plain conversations ---------------------------------

SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 400}, "after": {"type": "string"}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "calculate": {
        "type": "object",
        "properties": {"op": {"enum": ["add", "max"]}, "values": {"type": "array", "items": {"type": "number"}}},
        "required": ["op", "values"],
    },
    "lookup": {"type": "object", "properties": {"key": {"type": "string"}, "strict": {"type": "boolean"}}, "required": ["key", "strict"]},
}


def derived_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from conversations that hold none.

    Each assistant turn becomes a call whose arguments carry its text and
    figures of it, and refer to the assistant's turn before; each later user
    turn becomes the result of the turn before it.  Some are broken on
    purpose, by the hash of the text: wrong types, values out of range, text
    that is no JSON, unknown tools, results that name no call.
    """
    t = turns.withColumn("h", F.xxhash64("text")).withColumn("n", F.size(F.split("text", " ")))
    name = lambda turn: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), turn.cast("string"))
    ref = F.when(F.col("turn") >= 3, F.struct(name(F.col("turn") - 2).alias(REFERENCE)))
    search = F.to_json(F.struct(F.col("text").alias("query"), F.col("n").alias("limit"), ref.alias("after")))
    op = F.when(F.pmod("h", F.lit(5)) == 0, "divide").otherwise("add")
    calculate = F.to_json(F.struct(F.array(F.col("n").cast("double"), F.length("text") / 2).alias("values"), op.alias("op"), ref.alias("base")))
    strict = F.when(F.pmod("h", F.lit(7)) == 0, F.lit('"yes"')).otherwise(F.lit("true"))
    lookup = F.concat(F.lit('{ "strict" : '), strict, F.lit(' , "key" : '), F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)"), F.lit(" }"))
    kind = F.pmod("h", F.lit(3))
    args = F.when(F.pmod("h", F.lit(13)) == 0, F.concat(F.lit("{"), F.col("text"))).when(kind == 0, search).when(kind == 1, calculate).otherwise(lookup)
    tool = F.when(F.pmod("h", F.lit(17)) == 0, "translate").when(kind == 0, "search").when(kind == 1, "calculate").otherwise("lookup")
    calls = t.filter("role = 'assistant'").select("conv_id", "turn", name(F.col("turn")).alias("call_id"), tool.alias("name"), args.alias("arguments"))
    lost = F.when(F.pmod("h", F.lit(11)) == 0, F.lit("x")).otherwise(F.lit(""))
    results = t.filter("role = 'user' and turn > 0").select("conv_id", "turn", F.concat(name(F.col("turn") - 1), lost).alias("call_id"), F.col("text").alias("content"))
    return calls, results
