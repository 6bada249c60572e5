import json
import random
from collections import Counter

import duckdb
import pytest

from cairnspark.llm import chat

from .conftest import sf

CALLS = json.dumps({"tool_calls": [{"id": "c1", "name": "search", "arguments": {"query": "é \"x\"", "limit": 3}}, {"id": "c2", "name": "search", "arguments": {"limit": "3", "zz": [1, {"b": 1, "a": 2}]}}]})
ROWS = [
    (1, 0, "user", "hi\n\"there\" é \\ /"),
    (1, 1, "assistant", CALLS),
    (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "found"})),
    (1, 3, "tool", json.dumps({"tool_call_id": "c1", "content": "again"})),
    (1, 4, "tool", json.dumps({"tool_call_id": "nope", "content": "?"})),
    (1, 5, "assistant", json.dumps({"tool_calls": [{"id": "c1", "name": "none", "arguments": [1]}]})),
    (2, 0, "tool", json.dumps({"tool_call_id": "c9", "content": "early"})),
    (2, 3, "assistant", json.dumps({"tool_calls": [{"id": "c9", "name": "convert", "arguments": {"amount": 1.5, "source": "a", "target": None}}]})),
    (3, 0, None, None),
    (3, 1, "user", ""),
    (3, 2, "tool", "{broken"),
    (3, 3, "assistant", '{"tool_calls": []}'),
    (None, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "nowhere"})),
    (1, 9, "user", CALLS),
]


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id long, turn long, role string, text string, kind string, part int")
    return {(r.conv_id, r.turn, r.part): r for r in chat.formatted(df).collect()}


def test_links(got):
    status = {k: v.status for k, v in got.items()}
    assert status == {
        (1, 0, 0): "message", (1, 1, 0): "answered", (1, 1, 1): "unanswered", (1, 2, 0): "linked", (1, 3, 0): "repeated", (1, 4, 0): "orphan",
        (1, 5, 0): "duplicate", (2, 0, 0): "linked", (2, 3, 0): "answered", (3, 0, 0): "message", (3, 1, 0): "message", (3, 2, 0): "message",
        (3, 3, 0): "message", (None, 0, 0): "orphan", (1, 9, 0): "message",
    }


def test_results_come_after_their_calls(got):
    order = sorted((k for k in got if k[0] == 2), key=lambda k: (got[k].place, got[k].depth, k[1], k[2]))
    assert order == [(2, 3, 0), (2, 0, 0)]


def test_arguments_are_validated(got):
    assert {k: v.errors for k, v in got.items() if v.kind == "call"} == {(1, 1, 0): "", (1, 1, 1): "missing query; type limit; unknown zz", (1, 5, 0): "no object", (2, 3, 0): "missing target"}


def test_json_is_canonical(got):
    for (c, t, p), r in got.items():
        whole = json.loads(r.json)
        assert r.json == json.dumps(whole, sort_keys=True, separators=(",", ":"), ensure_ascii=False), r.json
    assert json.loads(got[1, 1, 1].json)["arguments"] == {"limit": "3", "zz": [1, {"a": 2, "b": 1}]}
    assert json.loads(got[1, 0, 0].json) == {"content": ROWS[0][3], "role": "user"} and got[3, 0, 0].json == '{"content":""}'


def test_table_equals_sql(spark):
    df = chat.formatted(spark.read.parquet(f"{sf}/conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(chat.SQL)
    assert sorted(map(str, map(tuple, df.select(rel.columns).collect()))) == sorted(map(str, rel.fetchall()))
    assert chat.formatted(spark.read.parquet(f"{sf}/conversations.parquet").limit(0)).count() == 0


def test_nothing_beside_calls_is_lost(spark):
    call = {"id": "c1", "type": "function", "index": 0, "function": {"name": "search", "arguments": '{"query": "a"}', "strict": True}}
    said = {"role": "assistant", "content": "I will \"look\"", "refusal": None, "meta": {"b": 1, "a": [1.5]}, "tool_calls": [call, {"id": "c2", "name": "calculator", "arguments": {"expression": "1"}, "x": None, "note": "n"}]}
    texts = [
        ("assistant", json.dumps(said)),
        ("tool", json.dumps({"tool_call_id": "c1", "content": "found", "name": "search", "id": 7, "role": "tool"})),
        ("assistant", json.dumps({"role": "assistant", "content": "", "tool_calls": [call | {"id": "c3"}]})),
        ("assistant", '{"content": "x", "a": 1, "a": 2, "tool_calls": [{"id": "c4", "name": "search", "arguments": {"query": "q"}}]}'),
        ("assistant", json.dumps({"tool_calls": [{"id": "c5", "name": "search", "arguments": {"query": "q"}, "function": "other"}]})),
        ("assistant", json.dumps({"seed": 1, "content": None, "tool_calls": [{"id": "c6", "function": {"name": "none"}}]})),
    ]
    rows = {(r.turn, r.part): r for r in chat.formatted(spark.createDataFrame([(1, i, *t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")).collect()}
    for r in rows.values():
        assert r.json == json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False), r.json
    found = {"arguments": {"query": "a"}, "function": {"strict": True}, "index": 0, "name": "search", "role": "assistant", "type": "function"}
    q = {"arguments": {"query": "q"}, "name": "search", "role": "assistant"}
    assert {k: json.loads(r.json) for k, r in rows.items()} == {
        (0, 0): {"content": "I will \"look\"", "meta": {"a": [1.5], "b": 1}, "role": "assistant"},
        (0, 1): found | {"id": "c1"},
        (0, 2): {"arguments": {"expression": "1"}, "id": "c2", "name": "calculator", "note": "n", "role": "assistant"},
        (1, 0): {"content": "found", "extra": {"id": 7}, "id": "c1", "name": "search", "role": "tool"},
        (2, 0): found | {"id": "c3"},
        (3, 0): {"content": "x", "raw": texts[3][1], "role": "assistant"},
        (3, 1): q | {"id": "c4"},
        (4, 0): q | {"function": "other", "id": "c5"},
        (5, 0): {"role": "assistant", "seed": 1},
        (5, 1): {"arguments": {}, "id": "c6", "name": "none", "role": "assistant"},
    }
    assert {k: (r.kind, r.status, r.errors) for k, r in rows.items() if k[0] < 2} == {(0, 0): ("message", "message", ""), (0, 1): ("call", "answered", ""), (0, 2): ("call", "unanswered", ""), (1, 0): ("result", "linked", "")}


def linked_by_hand(rows):
    """Status, place and errors of calls and results, by a plain loop."""
    calls, results = {}, {}
    for c, t, role, i, _ in rows:
        at = calls if role == "assistant" else results
        at[c, i] = min(at.get((c, i), t), t)
    out = Counter()
    for c, t, role, i, kind in rows:
        first, answer = calls.get((c, i)), results.get((c, i))
        if role == "assistant":
            status = "duplicate" if t != first else "unanswered" if answer is None else "answered"
            out[c, t, i, status, t, ("", "missing query; type limit", "unknown tool", "no object")[kind]] += 1
        else:
            status = "orphan" if first is None else "repeated" if answer != t else "linked"
            out[c, t, i, status, t if first is None else max(t, first), ""] += 1
    return out


def test_links_equal_a_plain_linker(spark):
    r = random.Random(8)
    calls = ['"name":"search","arguments":{"query":"q"}', '"name":"search","arguments":{"limit":"3"}', '"name":"none","arguments":{}', '"name":"search","arguments":[1]']
    rows = [(r.randrange(1500), r.randrange(9), r.choice(("assistant", "tool")), f"c{r.randrange(4)}", r.randrange(4)) for _ in range(9000)]
    rows += [(-1, i, r.choice(("assistant", "tool")), "hot", 0) for i in range(600)]  # one identifier of very many
    text = lambda role, i, k: f'{{"tool_calls":[{{"id":"{i}",{calls[k]}}}]}}' if role == "assistant" else f'{{"tool_call_id":"{i}","content":"x"}}'
    df = spark.createDataFrame([(c, t, role, text(role, i, k)) for c, t, role, i, k in rows], "conv_id long, turn long, role string, text string")
    got = Counter((x.conv_id, x.turn, x.call_id, x.status, x.place, x.errors) for x in chat.formatted(df).collect())
    assert got == linked_by_hand(rows)


def test_links_equal_sql(spark):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    df = chat.formatted(chat.with_calls(table)).drop("json")
    assert "Join" in df._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    rel = con.sql(chat.LINKS_SQL)
    assert sorted(map(str, map(tuple, df.select(rel.columns).collect()))) == sorted(map(str, rel.fetchall()))


def test_keys_are_in_order_of_utf16_units(spark):
    text = json.dumps({"tool_calls": [{"id": "c", "name": "none", "\uffff": 1, "😀": 2, "arguments": {"\uffff": 1, "😀": 2}}]})
    df = spark.createDataFrame([(1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    got = chat.formatted(df).first().json
    assert got == '{"arguments":{"😀":2,"\uffff":1},"id":"c","name":"none","role":"assistant","😀":2,"\uffff":1}'
