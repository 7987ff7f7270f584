from __future__ import annotations

import json

from speechmill.llm import toolcalls

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "ping": {}}


def link(spark, calls, results):
    out = toolcalls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    return {(r["conv_id"], r["call_id"]): r for r in out}, out


def test_links_validation_and_canonical_json(spark):
    calls = [
        (1, "x", 1, "add", '{ "b": 2.5, "a": 1 }', None),
        (1, "y", 3, "add", '{"a": "1", "note": 3}', "x"),
        (1, "z", 5, "ping", "{}", "y"),
        (1, "z", 4, "ping", "{}", "missing"),
        (1, "bad", 6, "ping", "not json", None),
        (1, "list", 6, "ping", "[1]", None),
        (1, "who", 7, "other", "{}", None),
        (2, "x", 1, "ping", None, None),
        (None, "x", 1, "ping", "{}", None),
        (3, None, 1, "ping", "{}", None),
    ]
    results = [(1, "x", 2, 'a "q"\n'), (1, "x", 9, "later"), (9, "x", 1, "alone"), (None, "x", 2, "lost")]
    by, every = link(spark, calls, results)
    assert by[1, "x"]["json"] == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result":"a \\"q\\"\\n"}'
    assert (by[1, "x"]["n_results"], by[1, "x"]["status"], by[1, "x"]["problems"], by[1, "x"]["depth"]) == (2, "linked", "", 0)
    assert (by[1, "y"]["problems"], by[1, "y"]["depth"], by[1, "y"]["status"]) == ("a:not integer;b:missing;note:not string", 1, "open")
    assert (by[1, "z"]["n_calls"], by[1, "z"]["turn"], by[1, "z"]["depth"]) == (2, 4, 0)
    assert by[1, "bad"]["problems"] == "arguments:not json" and by[1, "list"]["problems"] == "arguments:not an object"
    assert by[1, "who"]["problems"] == "name:unknown" and by[2, "x"]["problems"] == "arguments:not json"
    assert by[9, "x"]["status"] == "orphan"
    assert sorted(r["status"] for r in every if r["conv_id"] is None) == ["open", "orphan"]
    assert by[3, None]["status"] == "open"
    for r in every:
        assert list(json.loads(r["json"])) == ["arguments", "id", "name", "result"]


def test_depths_of_chains_trees_and_cycles(spark):
    rows = [(1, str(i), str(i - 1)) for i in range(70)] + [(2, "a", "b"), (2, "b", "a"), (2, "c", "a"), (2, "d", None), (2, "e", "d"), (2, "f", "d"), (2, "self", "self")]
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in toolcalls.depths(spark.createDataFrame(rows, "conv_id long, call_id string, after string")).collect()}
    assert [got[1, str(i)] for i in range(70)] == list(range(70))
    assert [got[2, k] for k in ("a", "b", "c", "d", "e", "f", "self")] == [-1, -1, -1, 0, 1, 1, -1]


def test_empty(spark):
    assert link(spark, [], [])[1] == []


def test_turns_with_nulls_and_repeats(spark):
    turns = spark.createDataFrame([(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, None, None), (None, 1, "user", "x"), (2, None, "user", "x"), (2, 5, "assistant", "y")], "conv_id long, turn long, role string, text string")
    out = toolcalls.link(*toolcalls.from_turns(turns), toolcalls.REPLY).collect()
    got = {(r["conv_id"], r["call_id"]): r for r in out}
    assert got[1, "0"]["n_calls"] == 2 and got[1, "0"]["status"] == "linked"
    assert got[1, "2"]["problems"] == "text:missing" and got[2, "4"]["status"] == "orphan"
    assert len(out) == 5


