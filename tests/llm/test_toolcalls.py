import json

from veilframe.llm import toolcalls as T

SCHEMA = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string", "maxLength": 3}}}}}


def test_violations():
    ok = lambda v: T.violations(v, SCHEMA["add"])
    assert ok({"a": 1, "tags": ["x"]}) == [] and ok({"a": 2.0}) == []
    assert ok([]) == ["$: not object"] and ok({"b": 1}) == ["$.a: missing", "$.b: unknown"]
    assert ok({"a": True}) == ["$.a: not integer"] and ok({"a": -1, "tags": ["long", 3]}) == ["$.a: too small", "$.tags[0]: too long", "$.tags[1]: not string"]


def test_links_order_and_status(spark):
    calls = spark.createDataFrame(
        [
            (1, "c", "add", '{"tags":["é"],"a":1}', "b", 0), (1, "b", "add", '{"a":2}', "a", 1), (1, "a", "add", '{"a":3}', None, 2), (1, "a", "add", '{"a":9}', None, 5),
            (1, "x", "add", '{"a":1}', "y", 3), (1, "y", "add", '{"a":1}', "x", 4), (1, "z", "add", "{", "gone", 6), (1, "q", "mul", "{}", None, 7),
            (2, "a", "add", None, None, 0), (2, "n", "add", '{"a": NaN}', None, 1), (2, None, "add", '{"a":1}', None, 2), (None, "a", "add", '{"a":1}', None, 0),
        ],
        "conv_id long, call_id string, name string, arguments string, after string, seq long",
    )
    results = spark.createDataFrame([(1, "a", "r2"), (1, "a", "r1"), (1, "c", ""), (1, "w", "lost"), (1, None, "no id"), (2, "b", None), (None, "a", "null key")], "conv_id long, call_id string, content string")
    got = {(r.conv_id, r.call_id): r for r in T.link_calls(calls, results, SCHEMA).collect()}
    assert {k: (r.depth, r.status) for k, r in got.items()} == {
        (1, "a"): (0, "ok"), (1, "b"): (1, "unanswered"), (1, "c"): (2, "ok"), (1, "x"): (None, "cycle"), (1, "y"): (None, "cycle"), (1, "z"): (0, "invalid"), (1, "q"): (0, "unknown_tool"),
        (2, "a"): (0, "invalid"), (2, "n"): (0, "invalid"), (1, "w"): (None, "orphan"), (1, None): (None, "orphan"), (2, "b"): (None, "orphan"), (None, "a"): (0, "ok"),
    }
    assert got[1, "c"].json == '{"after":"b","arguments":{"a":1,"tags":["é"]},"id":"c","name":"add","result":""}'
    assert json.loads(got[1, "a"].json) == {"after": None, "arguments": {"a": 3}, "id": "a", "name": "add", "result": "r1"}
    assert T.link_calls(calls.limit(0), results.limit(0), SCHEMA).count() == 0


def test_long_chain(spark):
    nodes = spark.range(1, 300).selectExpr("cast(id as string) node", "case when id > 1 then cast(id - 1 as string) end parent")
    assert {int(r.node): r.depth for r in T.depths(nodes).collect()} == {i: i - 1 for i in range(1, 300)}


def test_turns_that_are_no_calls(spark):
    chat = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, None, "user", "no number"), (1, None, "assistant", "none"), (1, 3, None, "x"), (1, 4, "tool", "x")], "conv_id long, turn long, role string, text string")
    got = T.link_calls(*T.from_conversations(chat), T.SCHEMAS).collect()
    assert sorted((r.call_id or "", r.status) for r in got) == [("", "orphan"), ("t1", "ok")]


def test_calls_that_wait_for_several(spark):
    """Random graphs with cycles, missing and repeated predecessors, beside plain longest paths; and long diamonds."""
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for conv in range(12):
        after = {f"c{i}": [f"c{rng.randrange(i)}" for _ in range(rng.randrange(0, 4))] if i and rng.random() < 0.8 else None for i in range(14)}
        if conv % 3 == 0:
            after["c2"] = ["c5", "c1"]
            after["c5"] = ["c2"]
        if conv % 3 == 1:
            after["c4"] = ["c3", "nobody", None, "c3"]
        depth = {}
        while True:
            new = {c: max([depth[p] + 1 for p in set(ps or []) if p in after], default=0) for c, ps in after.items() if c not in depth and all(p in depth for p in ps or [] if p in after)}
            if not new:
                break
            depth |= new
        for c, ps in after.items():
            rows.append((conv, c, "add", '{"a":1}', ps, int(c[1:])))
            want[conv, c] = depth.get(c)
    chain = {0: [], **{i: [f"c{i - 1}"] if i % 5 else [f"c{i - 1}", f"c{i - 3}"] for i in range(1, 60) if i >= 1}}
    rows += [(99, f"c{i}", "add", '{"a":1}', ps if i >= 3 or len(ps) == 1 else [], i) for i, ps in chain.items()]
    want |= {(99, f"c{i}"): i for i in chain}
    calls = spark.createDataFrame(rows, "conv_id long, call_id string, name string, arguments string, after array<string>, seq long")
    got = T.link_calls(calls, calls.limit(0).selectExpr("conv_id", "call_id", "name content"), SCHEMA).collect()
    assert {(r.conv_id, r.call_id): r.depth for r in got} == want
    assert all((r.status == "cycle") == (r.depth is None) for r in got)
    assert json.loads(next(r.json for r in got if r.conv_id == 99 and r.call_id == "c5"))["after"] == ["c4", "c2"]


def test_odd_json_does_not_end_the_job(spark):
    deep = "[" * 200_000 + "]" * 200_000
    odd = ["1e400", '{"a":1e400}', '"\\ud800"', '{"a":1,"\\udc00":2}', deep, '{"a":' + "9" * 5000 + "}", "NaN", "", "{}x", '{"a":1,"a":2}', "null", '"\\ud83d\\ude00"']
    calls = spark.createDataFrame([("k", str(i), "add", t, None, i) for i, t in enumerate(odd)], "conv_id string, call_id string, name string, arguments string, after string, seq int")
    results = spark.createDataFrame([("k", "9", "r")], "conv_id string, call_id string, content string")
    got = {int(r.call_id): r for r in T.link_calls(calls, results, SCHEMA).collect()}
    assert {i for i, r in got.items() if r.status == "ok"} == {9} and all(r.status == "invalid" for i, r in got.items() if i != 9)
    assert [r.errors for i, r in sorted(got.items()) if i in (0, 1, 4, 5, 6, 7, 8)] == [["$: no JSON"]] * 7
    assert got[3].errors == ["$.\\udc00: unknown"] and '"\\udc00":2' in got[3].json and '"arguments":"😀"' in got[11].json
    assert json.loads(got[9].json)["arguments"] == {"a": 2} and json.loads(got[4].json)["arguments"] == deep
    for r in got.values():
        json.loads(r.json)


def test_unknown_types_and_enums():
    assert T.violations(1, {"type": "whatever"}) == ["$: not whatever"] and T.violations(1, {"type": ["whatever", "integer"]}) == []
    enum = lambda v, *of: T.violations(v, {"enum": list(of)}) == []
    assert enum(1, 1.0) and not enum(True, 1) and not enum(0, False) and enum([1, {"a": True}], [1.0, {"a": True}]) and not enum([True], [1]) and not enum({"a": 1}, {"a": True}) and enum(None, None)


def test_query_shows_every_status(spark):
    """The registered query beside a plain reading of the conversations."""
    data = "/root/testdata/sf0.1"
    from veilframe.llm import queries

    chat = spark.read.parquet(f"{data}/conversations.parquet")
    rows = chat.selectExpr("conv_id", "turn", "role", "text", "pmod(xxhash64(conv_id, turn), 64L) as fault").collect()
    got = queries.op7_tool_calls(spark, data).collect()
    by = {(r.conv_id, r.call_id): r for r in got if r.status != "orphan"}
    said = {(r.conv_id, r.turn) for r in rows if r.role == "assistant"}
    calls = {(r.conv_id, r.turn): r for r in rows if r.role == "user"}
    after = {(c, t): [(c, u) for u, yes in ((t - 4, t >= 4), (t - 2, t >= 2), (t + 2, r.fault == 5)) if yes and (c, u) in calls] for (c, t), r in calls.items()}
    depth: dict = {}
    while True:
        ready = {x: max([depth[p] + 1 for p in ps], default=0) for x, ps in after.items() if x not in depth and all(p in depth for p in ps)}
        if not ready:
            break
        depth |= ready
    want = {}
    for (c, t), r in calls.items():
        bad = r.fault in (1, 2, 3, 4) or not r.text
        want[c, f"t{t}"] = (depth.get((c, t)), "cycle" if (c, t) not in depth else "unknown_tool" if r.fault == 0 else "invalid" if bad else "ok" if (c, t + 1) in said else "unanswered")
    assert {k: (r.depth, r.status) for k, r in by.items()} == want
    assert {"ok", "cycle", "unknown_tool", "invalid"} <= {s for _, s in want.values()}
