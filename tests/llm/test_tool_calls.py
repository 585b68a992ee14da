"""Linking, ordering, validation and serialisation of tool calls."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mathgrade.llm import tool_calls as tc

SCHEMA = "conv_id long, turn long, role string, text string, call struct<id:string,name:string,arguments:string,depends_on:array<string>>, answers string, status string, level int"


def call(ident, name="search", arguments='{"query":"q","limit":5}', needs=()):
    return (ident, name, arguments, list(needs))


def link(spark, rows):
    return tc.link(spark.createDataFrame([(*r, "s", 3) for r in rows], SCHEMA)).collect()


def test_status_of_every_kind(spark):
    rows = [(1, 0, "system", "hi", None, None), (1, 1, "assistant", "a", call("x"), None), (1, 2, "tool", "r", None, "x"), (1, 3, "tool", "r2", None, "x"),
            (1, 4, "assistant", "b", call("x"), None), (1, 5, "assistant", "c", call("y"), None), (1, 6, "tool", "?", None, "zz"), (2, 1, "tool", "r", None, "x"),
            (None, 3, "assistant", None, call("n"), None), (None, None, "tool", "early", None, "n"), (None, 4, "tool", None, None, "n")]
    got = {(r.conv_id, r.turn): r.status for r in link(spark, rows)}
    assert got == {(1, 0): "plain", (1, 1): "ok", (1, 2): "ok", (1, 3): "extra_result", (1, 4): "duplicate_call", (1, 5): "no_result", (1, 6): "orphan_result",
                   (2, 1): "orphan_result", (None, 3): "ok", (None, None): "orphan_result", (None, 4): "ok"}


def test_repeated_rows(spark):
    got = link(spark, [(1, 1, "assistant", "a", call("x"), None)] * 3 + [(1, 2, "tool", "r", None, "x")] * 2)
    assert sorted(r.status for r in got) == ["duplicate_call", "duplicate_call", "extra_result", "ok", "ok"]


def test_topological_levels(spark):
    rows = [(1, i, "assistant", "", call(f"c{i}", needs=n), None) for i, n in enumerate([["c2"], [], ["c1", "c3"], [], ["c0", "c9"]])]
    rows += [(2, i, "assistant", "", call(f"c{i}", needs=n), None) for i, n in enumerate([["c1"], ["c0"], [], ["c0"]])]
    rows += [(3, i, "assistant", "", call(f"c{i}", needs=n), None) for i, n in enumerate([[], ["c0"], ["c1", "c0", None]])]
    got = {(r.conv_id, r.turn): r for r in link(spark, rows)}
    assert [got[1, i].level for i in range(5)] == [2, 0, 1, 0, 3]
    assert [(got[2, i].level, got[2, i].status) for i in range(4)] == [(-1, "cycle"), (-1, "cycle"), (0, "no_result"), (-1, "cycle")]
    assert [got[3, i].level for i in range(3)] == [0, 1, 2]
    assert got[1, 4].errors == ["depends_on: unknown c9"]


def plain_levels(needs):
    """Longest chain of dependencies of each call; -1 in or behind a cycle."""
    level = {}
    while True:
        ready = [c for c in needs if c not in level and all(n in level for n in needs[c])]
        if not ready:
            return {c: level.get(c, -1) for c in needs}
        level |= {c: max((level[n] + 1 for n in needs[c]), default=0) for c in ready}


def test_levels_of_random_dependencies(spark):
    rng = random.Random(8)
    needs = {}
    for conv in range(12):
        n = rng.randint(1, 25)
        for i in range(n):
            few = rng.choice([0, 1, 1, 1, 1, 2, 3])
            reach = range(n) if conv % 3 == 0 else range(i)  # every third conversation may hold cycles
            needs[conv, i] = rng.sample(list(reach), min(few, len(reach)))
    want = {}
    for conv in range(12):
        want |= {(conv, c): v for c, v in plain_levels({i: n for (k, i), n in needs.items() if k == conv}).items()}
    assert -1 in want.values() and max(want.values()) > 6
    calls = spark.createDataFrame([(str(k), str(i)) for k, i in needs], "conv_id string, call_id string")
    edges = spark.createDataFrame([(str(k), str(i), str(n)) for (k, i), ns in needs.items() for n in ns], "conv_id string, call_id string, needs string")
    got = {(int(r.conv_id), int(r.call_id)): r.level for r in tc.levels(calls, edges).collect()}
    assert got == want


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 1000
    rounds = []
    keep = tc.stored
    monkeypatch.setattr(tc, "stored", lambda df, name: (rounds.append(name), keep(df, name))[1])
    calls = spark.range(n).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"))
    edges = spark.range(1, n).select(F.lit("c").alias("conv_id"), F.col("id").cast("string").alias("call_id"), (F.col("id") - 1).cast("string").alias("needs"))
    got = {int(r.call_id): r.level for r in tc.levels(calls, edges).collect()}
    assert got == {i: i for i in range(n)} and rounds.count("pointers") <= 13


@pytest.mark.parametrize(("name", "arguments", "errors"), [
    ("search", '{"query":"q","limit":5}', []),
    ("search", '{"limit":5.0,"query":"q"}', []),
    ("search", '{"query":"","limit":0}', ["limit: minimum 1", "query: minLength 1"]),
    ("search", '{"limit":"5","mode":"some","zeta":1,"alpha":{}}', ["limit: not integer", "mode: not allowed", "query: missing", "alpha: unexpected", "zeta: unexpected"]),
    ("search", '{"query":null,"limit":101,"exact":1}', ["exact: not boolean", "limit: maximum 100", "query: not string"]),
    ("lookup", '{"query":"q","offset":1.5}', ["offset: not integer"]),
    ("note", '{"body":"' + "x" * 1001 + '"}', ["body: maxLength 1000"]),
    ("note", "[1]", ["arguments: not a JSON object"]),
    ("note", '{"body":', ["arguments: not a JSON object"]),
    ("note", '{"body":"a","body":"b"}', ["arguments: not a JSON object"]),
    ("note", None, ["arguments: not a JSON object"]),
    ("other", "{}", ["other: unknown tool"]),
    (None, "{}", [": unknown tool"]),
])
def test_validation(spark, name, arguments, errors):
    got, = link(spark, [(1, 1, "assistant", "t", call("x", name, arguments), None)])
    assert got.errors == errors


def test_canonical_json(spark):
    rows = [(1, 1, "assistant", 'say "hi"\n\\ é/\t\x01', call("x", "search", ' { "query" : "b\\u00e9" , "limit" : 1, "a":{"z":1,"b":[ 1 , 2]} }'), None),
            (1, 2, "tool", None, None, "x"), (1, 3, "user", "", None, None)]
    got = {r.turn: r.json for r in link(spark, rows)}
    assert got[1] == json.dumps({"content": rows[0][3], "role": "assistant", "tool_calls": [
        {"arguments": {"a": {"b": [1, 2], "z": 1}, "limit": 1, "query": "bé"}, "id": "x", "name": "search"}]}, ensure_ascii=False, separators=(",", ":"))
    assert got[2] == '{"content":null,"role":"tool","tool_call_id":"x"}' and got[3] == '{"content":"","role":"user"}'


def test_derived_calls_and_native_plan(spark, sf):
    conv = spark.read.parquet(f"{sf}/conversations.parquet")
    out = tc.link(tc.calls_of(conv))
    rows = out.collect()
    assert len(rows) == conv.count() and all(json.loads(r.json) for r in rows)
    assert {"call", "result", "message"} == {r.kind for r in rows}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert link(spark, []) == []
    assert tc.link(tc.calls_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
