import json
import random

import pytest

from postlab.llm import chat

SCHEMAS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {
    "a": {"type": "integer", "minimum": 1, "maximum": 9}, "b": {"type": "array", "items": {"type": "string"}},
    "c": {"type": "string", "enum": ["x"], "minLength": 1}}}}


def test_schema():
    check = lambda text: chat.checked("f", text, SCHEMAS)
    assert check('{"b": ["é"],  "a": 1}') == ("", '{"a":1,"b":["é"]}')
    assert check("{}")[0] == "$.a: missing"
    assert check('{"a": 10, "b": [1], "c": "y", "d": 0}')[0] == (
        "$.a: too large; $.b[0]: not string; $.c: not allowed; $.d: unknown")
    assert check('{"a": true}')[0] == "$.a: not integer"
    assert check("[1]") == ("$: not object", "[1]")
    assert check(None) == check("{") == ("$: not JSON", "null")
    assert chat.checked("g", "{}", SCHEMAS) == ("$: unknown tool", "{}")


def test_arguments_beyond_strict_json():
    check = lambda text: chat.checked("f", text, SCHEMAS)
    for text in ('{"a":"\\ud800"}', '{"\\udc00":1}', '{"a":NaN}', '{"a":-Infinity}', '{"a":1e400}', '{"a":1,"a":2}',
                 "[" * 200 + "]" * 200, "[" * 100_000 + "]" * 100_000, "1" * 5_000, '{"a":1} x', ""):
        assert check(text) == ("$: not JSON", "null"), text[:30]
    assert check('{"a": 5.0}') == ("", '{"a":5.0}')
    assert check('{"a": 5.5}')[0] == "$.a: not integer"
    assert check('{"a": "\\ud83d\\ude00"}')[1] == '{"a":"😀"}'
    with pytest.raises(ValueError):
        chat.check_schema({"properties": {"x": {"type": "date"}}})


def test_link_takes_odd_arguments(spark):
    odd = ['{"a":"\\ud800"}', '{"a":NaN}', '{"a":1,"a":2}', "[" * 5000, '{"a":' + "9" * 5000 + "}", '{"a": 3.0}']
    calls = spark.createDataFrame([(1, str(i), i, "f", t, None) for i, t in enumerate(odd)],
                                  "conv_id long, call_id string, turn long, name string, arguments string, parent_id string")
    results = spark.createDataFrame([(1, "0", 1, "r")], "conv_id long, call_id string, turn long, content string")
    out = chat.link(calls, results, SCHEMAS)
    assert [r.valid for r in out.orderBy("turn").collect()] == [False] * 5 + [True]
    assert "ShuffledHashJoin" in chat.link(calls, results, SCHEMAS)._jdf.queryExecution().executedPlan().toString()


def plain_link(calls, results):
    """One row per key by dictionaries: earliest turn, then smallest arguments."""
    first, answers, copies, more = {}, {}, {}, {}
    for c, k, turn, name, args, parent in calls:
        if c is not None and k is not None:
            copies[c, k] = copies.get((c, k), 0) + 1
            first[c, k] = min(first.get((c, k), (turn, args, name, parent)), (turn, args, name, parent))
    for c, k, turn, content in results:
        if c is not None and k is not None:
            more[c, k] = more.get((c, k), 0) + 1
            answers[c, k] = min(answers.get((c, k), (turn, content)), (turn, content))

    def depth(c, k):
        seen = set()
        while True:
            if k in seen:
                return None
            seen.add(k)
            up = first[c, k][3]
            if (c, up) not in first:
                return len(seen) - 1
            k = up

    return {key: ("orphan", None, None, more[key]) if key not in first else
            ("answered" if key in answers else "unanswered", depth(*key), copies[key], more.get(key))
            for key in first.keys() | answers.keys()}


def test_link_equals_dictionaries(spark):
    rng = random.Random(6)
    calls = [(rng.randrange(9), f"k{rng.randrange(25)}", rng.randrange(50), "f", '{"a":%d}' % rng.randrange(12),
              rng.choice([None, f"k{rng.randrange(25)}"])) for _ in range(200)]
    results = [(rng.randrange(9), f"k{rng.randrange(30)}", rng.randrange(50), f"r{i}") for i in range(150)]
    out = chat.link(
        spark.createDataFrame(calls, "conv_id long, call_id string, turn long, name string, arguments string, "
                                     "parent_id string"),
        spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string"), SCHEMAS).collect()
    assert {(r.conv_id, r.call_id): (r.status, r.depth, r.copies, r.result_copies) for r in out} == plain_link(
        calls, results)
    place = {(r.conv_id, r.call_id): n for n, r in enumerate(out)}
    for r in out:
        up = json.loads(r.json)["parent"]
        if r.depth:
            assert place[r.conv_id, up] < place[r.conv_id, r.call_id]


def test_link(spark):
    calls = [(1, f"k{i}", i, "f", '{"a": 1}', f"k{i - 1}" if i else None, 0) for i in range(20)]
    calls += [(1, "k3", 30, "f", "{}", None, 0), (2, "x", 0, "f", "{}", "y", 0), (2, "y", 1, "f", None, "x", 0),
              (2, "z", 2, "f", "{}", "gone", 0), (3, None, 0, "f", "{}", None, 0)]
    results = [(1, "k0", 1, "line\n\"q\""), (1, "k0", 2, "late"), (9, "k0", 1, "lost"), (9, None, 1, "x")]
    calls = spark.createDataFrame(
        calls, "conv_id long, call_id string, turn long, name string, arguments string, parent_id string, depth int")
    results = spark.createDataFrame(results, "conv_id long, call_id string, turn long, content string")
    out = chat.link(calls, results, SCHEMAS)
    rows = out.collect()
    got = {(r.conv_id, r.call_id): r for r in rows}
    assert [r.call_id for r in rows if r.conv_id == 1] == [f"k{i}" for i in range(20)]
    assert [got[1, f"k{i}"].depth for i in range(20)] == list(range(20))
    assert got[1, "k3"].copies == 2 and got[1, "k3"].valid
    assert got[1, "k0"].status == "answered" and got[1, "k0"].result_copies == 2
    assert json.loads(got[1, "k0"].json) == {"id": "k0", "name": "f", "parent": None, "arguments": {"a": 1},
                                             "result": "line\n\"q\""}
    assert got[9, "k0"].status == "orphan" and got[9, "k0"].valid is None
    assert got[2, "x"].depth is None and got[2, "y"].depth is None and got[2, "z"].depth == 0
    assert len(rows) == 24
    for r in rows:
        assert r.json == chat.canonical(json.loads(r.json))
    assert chat.link(calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_no_size_of_files_decides_what_is_broadcast(spark, monkeypatch):
    """Files of calls are small beside their rows: beyond the limit nothing goes through the driver."""
    calls = spark.range(60).selectExpr(
        "id % 3 AS conv_id", "concat('k', id) AS call_id", "id AS turn", "'f' AS name", "'{}' AS arguments",
        "if(id < 3, null, concat('k', id - 3)) AS parent_id")
    results = calls.limit(0).selectExpr("conv_id", "call_id", "turn", "name AS content")
    plain = sorted(chat.link(calls, results, SCHEMAS).select("call_id", "depth").collect())
    sized = chat.join_sized
    monkeypatch.setattr(chat, "join_sized", lambda *a: sized(*a, limit=0))
    written, settle = [], chat.settle
    monkeypatch.setattr(chat, "settle", lambda df: written.append(
        df._jdf.queryExecution().executedPlan().toString()) or settle(df))
    out = chat.link(calls, results, SCHEMAS)
    written.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(written) > 4 and not any("BroadcastHashJoin" in plan for plan in written)
    assert sorted(out.select("call_id", "depth").collect()) == plain == sorted(
        (f"k{i}", i // 3) for i in range(60))
