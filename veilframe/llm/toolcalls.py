"""Chat formatting: tool calls linked to their results, ordered by what they depend on, checked and written as JSON."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import map_text, stored

TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, TYPES.get(kind, ()))


def _same(a, b) -> bool:
    """Equal JSON values: numbers by value, true and false are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(v, b[k]) for k, v in a.items())
    return a == b


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What of the JSON schema the value breaks: type, enum, required, properties, additionalProperties, items, bounds and lengths.

    A type that JSON schemas don't know fits no value.
    """
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {'/'.join(kinds)}"]
    out = [f"{at}: not in enum"] if "enum" in schema and not any(_same(value, x) for x in schema["enum"]) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at}.{k}: unknown" for k in sorted(value) if k not in known]
        for k in sorted(known):
            if k in value:
                out += violations(value[k], known[k], f"{at}.{k}")
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += violations(v, schema.get("items", {}), f"{at}[{i}]")
    elif isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", math.inf) else []
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] if value < schema.get("minimum", -math.inf) else []
        out += [f"{at}: too large"] if value > schema.get("maximum", math.inf) else []
    return out


def _refuse(x):
    raise ValueError(f"{x} is no JSON number")


def _finite(x: str) -> float:
    return y if math.isfinite(y := float(x)) else _refuse(x)


def read_json(text: str):
    """The value; a ValueError for what is no JSON, and for numbers too large to hold."""
    return json.loads(text, parse_constant=_refuse, parse_float=_finite)


def whole(s: str) -> str:
    """Halves of surrogate pairs, which no encoding can hold, as escapes."""
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", s)


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, and other characters than ASCII as they are (halves of surrogate pairs: escaped)."""
    return whole(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def depths(nodes: DataFrame) -> DataFrame:
    """Steps from each node to its root: (node, depth) of the forest (node, parent), as levels() gives them."""
    return levels(nodes, nodes)


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, depth): the most steps from a node without parents, of the graph (node, parent); null on a cycle or behind one.

    Nodes of one parent are first followed up to the next one of none or several, by pointers that double each round; only
    nodes of several parents are then ordered level by level, each once all its parents are: as many rounds as there are such
    nodes one behind the other. Parents that are no nodes are left out, as are most of those that another parent waits for.
    """
    ids = nodes.select("node").distinct()
    e = stored(edges.where("node is not null and parent is not null").select("node", "parent").distinct().join(ids.withColumnRenamed("node", "parent"), "parent", "left_semi"))
    # a parent that another parent of the node waits for says nothing more; taken out only if that one's name is larger, so
    # that of parents on a cycle one stays
    over = e.select("node", F.col("parent").alias("via")).join(e.select(F.col("node").alias("via"), "parent"), "via").where("via > parent").select("node", "parent").distinct()
    e = stored(e.join(over, ["node", "parent"], "left_anti"))
    n = e.groupBy("node").agg(F.count("*").alias("n"), F.min("parent").alias("only"))
    one = F.col("n") == 1
    state = stored(ids.join(n, "node", "left").select("node", F.when(one, F.col("only")).otherwise(F.col("node")).alias("at"), F.when(one, 1).otherwise(0).cast("long").alias("dist"), F.coalesce(one, F.lit(False)).alias("going"), F.coalesce("n", F.lit(0)).alias("n")))
    limit = max(1, math.ceil(math.log2(max(2, state.count()))) + 1)
    for _ in range(limit):
        if state.where("going").isEmpty():
            break
        there = state.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("dist").alias("more"), F.col("going").alias("on"))
        moved = state.where("going").join(there, "at").select("node", F.col("next").alias("at"), (F.col("dist") + F.col("more")).alias("dist"), F.col("on").alias("going"), "n")
        state = stored(state.where("not going").unionByName(moved))
    known = state.where("n = 0").select(F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"))
    steps = e.join(state.where("n > 1").select("node"), "node", "left_semi")
    steps = steps.join(state.where("not going").select(F.col("node").alias("parent"), "at", "dist"), "parent", "left").select("node", "at", (F.col("dist") + 1).alias("step"))
    open_ = stored(steps)
    while not open_.isEmpty():
        ready = open_.where("at is not null").join(known, "at").groupBy("node").agg(F.count("*").alias("k"), F.max(F.col("depth") + F.col("step")).alias("depth"))
        full = stored(open_.groupBy("node").agg(F.count("*").alias("all")).join(ready, "node").where("k = all").select(F.col("node").alias("at"), "depth"))
        if full.isEmpty():
            break
        known = stored(known.unionByName(full))
        open_ = stored(open_.join(full.select(F.col("at").alias("node")), "node", "left_anti"))
    done = state.where("not going").join(known, "at", "left").select("node", (F.col("depth") + F.col("dist")).alias("depth"))
    return done.unionByName(state.where("going").select("node", F.lit(None).cast("long").alias("depth")))


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict], *, keys: tuple[str, ...] = ("conv_id",)) -> DataFrame:
    """One row for each tool call and for each result without a call.

    calls: keys, call_id, name, arguments (JSON), after (call_id of the call that must come first, an array of several, or null), seq.
    results: keys, call_id, content. Both are hash-joined by keys and call_id. Returns keys, call_id, seq, depth
    (0 for calls that wait for none: rows ordered by depth, seq and call_id are in topological order), status, errors, json.

    status: ok; invalid (arguments are no JSON, hold a number beyond a double, nest too deep, or break the schema); unknown_tool; unanswered; cycle (depth null); orphan (a
    result without a call). The first that holds in the order cycle, unknown_tool, invalid, unanswered is told; errors
    lists the schema's violations. json is the canonical form of after, arguments, id, name and result.

    Of calls that share an id the one with the smallest (seq, name, arguments) counts, of results the smallest content.
    Null ids match nothing: such calls are left out, such results are orphans. A call that names a missing
    one waits for none. Null arguments are invalid. Empty tables give empty results; other columns are not looked at.
    """
    k = list(keys)
    first = calls.where(F.col("call_id").isNotNull()).groupBy(*k, "call_id").agg(F.min(F.struct(*[F.struct(F.col(c).isNull(), c).alias(f"o_{c}") for c in ("seq", "name", "arguments", "after")])).alias("m"))
    first = first.select(*k, "call_id", *[F.col(f"m.o_{c}.{c}").alias(c) for c in ("seq", "name", "arguments", "after")])
    node = lambda c: F.to_json(F.struct(*k, F.col(c).alias("id")), {"ignoreNullFields": "false"})
    first = stored(first.select("*", node("call_id").alias("node")))
    several = isinstance(first.schema["after"].dataType, T.ArrayType)
    edges = first.select(*k, F.col("node").alias("own"), (F.explode("after") if several else F.col("after")).alias("one")).where("one is not null").select(F.col("own").alias("node"), node("one").alias("parent"))
    ordered = levels(first, edges)
    answers = results.where(F.col("call_id").isNotNull()).select(node("call_id").alias("node"), "content", *[F.col(c).alias(f"r_{c}") for c in k], F.col("call_id").alias("r_id"))
    answers = answers.groupBy("node").agg(F.min("content").alias("content"), F.count("*").alias("n"), *[F.first(f"r_{c}").alias(f"r_{c}") for c in k], F.first("r_id").alias("r_id"))
    both = first.join(ordered, "node", "left").join(answers, "node", "full")
    nameless = results.where(F.col("call_id").isNull()).select(*[F.col(c).alias(f"r_{c}") for c in k], "content")
    both = both.unionByName(nameless, allowMissingColumns=True)
    rows = both.select(
        *[F.coalesce(c, f"r_{c}").alias(c) for c in k], F.coalesce("call_id", "r_id").alias("call_id"), "seq", "depth",
        F.to_json(F.struct(F.col("call_id").isNotNull().alias("call"), (F.col("n") > 0).alias("answered"), F.coalesce("call_id", "r_id").alias("id"), "name", "arguments", "after", "content", F.col("depth").isNull().alias("cycle"))).alias("__row"),
    )

    def start():
        def check(rows):
            out = []
            for r in map(json.loads, rows):
                call = {"after": r.get("after"), "arguments": r.get("arguments"), "id": r.get("id"), "name": r.get("name"), "result": r.get("content")}
                errors, line = [], None
                if r["call"]:
                    try:
                        value = read_json(r.get("arguments"))
                        errors = violations(value, schemas.get(r.get("name"), {}))
                        line = canonical(call | {"arguments": value})
                    except (ValueError, TypeError, RecursionError):
                        errors = ["$: no JSON"]
                status = "orphan" if not r["call"] else "cycle" if r["cycle"] else "unknown_tool" if r.get("name") not in schemas else "invalid" if errors else "ok" if r.get("answered") else "unanswered"
                out.append((status, [whole(e) for e in errors], line or canonical(call)))
            return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

        return check

    return map_text(rows, "__row", "status string, errors array<string>, json string", start, keep=[*k, "call_id", "seq", "depth"])


#: The tool that query op7 sees in the conversations: each user's turn asks for a reply.
SCHEMAS = {"reply": {"type": "object", "required": ["prompt", "turn"], "additionalProperties": False, "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}}}


def from_conversations(chat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of (conv_id, turn, role, text): a user's turn is a call of 'reply' that waits for the calls two and
    four turns before; what an assistant says is the result of the call one turn before.

    The conversations hold no faults of their own, so a digest of (conv_id, turn), pmod 64, decides on some: 0: the tool is
    'fetch', which nobody knows; 1: the turn is told as a string; 2: the prompt is missing, and there is a field that
    nobody knows; 3: the arguments end too early; 4: the turn is 1e999; 5: the call waits for the next one as well, which waits for it.

    Turns of other roles (system, null) are neither calls nor results and are left out. A user's turn without a number has no
    call id and is left out too; an assistant's is an orphan.
    """
    name = lambda back: F.concat(F.lit("t"), (F.col("turn") - back).cast("string"))
    fault = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(64))
    good = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    arguments = (
        F.when(fault == 1, F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").cast("string").alias("turn")))).when(fault == 2, F.to_json(F.struct("turn", F.col("role").alias("speaker"))))
        .when(fault == 3, F.expr("left(good, length(good) - 1)")).when(fault == 4, F.concat(F.expr("left(good, length(good) - 1)"), F.lit(',"turn":1e999}'))).otherwise(F.col("good"))
    )
    calls = chat.where("role = 'user'").withColumn("good", good).select(
        "conv_id", name(0).alias("call_id"), F.when(fault == 0, "fetch").otherwise("reply").alias("name"), arguments.alias("arguments"),
        F.filter(F.array(F.when(F.col("turn") >= 4, name(4)), F.when(F.col("turn") >= 2, name(2)), F.when(fault == 5, name(-2))), lambda x: x.isNotNull()).alias("after"), F.col("turn").alias("seq"),
    )
    results = chat.where("role = 'assistant'").select("conv_id", name(1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
