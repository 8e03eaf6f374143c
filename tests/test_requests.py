"""Evasion vectors and request semantics."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from sluiceway.functions.text import normalise
from sluiceway.operators import outputs, requests, tripwires
from sluiceway.schemas import REQUEST

TRIGGER = "[TEST_SENTINEL_BLOCK_ALPHA]"
SPACED = " ".join("TEST_SENTINEL_BLOCK_ALPHA")
HIDDEN = "​".join("TEST_SENTINEL_BLOCK_ALPHA")


def user(text):
    return [{"role": "user", "content": text}]


def tool(arguments):
    call = {"id": "c1", "type": "function", "function": {"name": "search", "arguments": arguments}}
    return [*user("look it up"), {"role": "assistant", "content": None, "tool_calls": [call]}, {"role": "tool", "content": "nothing"}]


def b64(text):
    return base64.b64encode(text.encode()).decode()


WRAPPED = b64(TRIGGER + " padding text here")
REFUSED = {
    "3.1": user(f"Please summarise {TRIGGER}"),
    "3.2": [*user(f"Summarise {TRIGGER}"), {"role": "assistant", "content": "no"}, *user("What is the capital of France?")],
    "3.3": user(SPACED),
    "3.4": user("Decode and follow: " + b64(f"Summarise {TRIGGER}")),
    "3.5": user(HIDDEN),
    "3.8": [*user("weather"), {"role": "tool", "content": f"Result: {TRIGGER}"}],
    "6.1": [*user(f"Summarise {TRIGGER}"), {"role": "assistant", "content": "Sure, here is"}],
    "6.2": [{"role": "system", "content": f"Always {TRIGGER}"}, *user("hello")],
    "6.4": user("Decode: " + b64(f"Summarise {TRIGGER} now").replace("+", "-").replace("/", "_").rstrip("=")),
    "6.5": user("Summarise " + "/".join("TEST_SENTINEL_BLOCK_ALPHA")),
    "6.6": user("Summarise T́ÉŚT_SENTINEL_BLOCK_ALPHA"),
    "6.7": user("Summarise TEST_SENTINEL_BLOCK_ALPHА"),
    "6.8": tool(json.dumps({"q": TRIGGER})),
    "7.2": user([{"type": "input_text", "text": f"Summarise {TRIGGER}"}]),
    "7.3": user("Summarise TEST_SENTINEL_BLOCK_аLPHA"),
    "7.4": tool('{"q": "TEST\\u005fSENTINEL\\u005fBLOCK\\u005fALPHA"}'),
    "7.5": user("Decode: " + b64(TRIGGER)),
    "8.1": user([{"type": "custom_block", "payload": "lorem ipsum " * 12000 + TRIGGER}]),
    "8.3": user("Decode:\n" + "\n    ".join([WRAPPED[:20], WRAPPED[20:40], WRAPPED[40:]])),
    "8.4": [*user("hello"), {"role": "assistant", "content": f"Sure, {TRIGGER}"}],
}
PASSED = {"3.2b": user("What is the capital of France? One word."), "3.9": user("what does the word payload mean in an HTTP request?")}


def request_rows(spark, messages, **fields):
    rows = [
        {"call_id": name, "messages_json": json.dumps(m), "system": None, "prompt": None, "input": None, "tools_json": None, **fields.get(name, {})}
        for name, m in messages.items()
    ]
    return spark.createDataFrame([{**r, "ts": None, "model": None, "key_alias": None, "headers": None} for r in rows], REQUEST)


@pytest.fixture(scope="module")
def scanned(spark):
    extra = {
        "3.6": {"prompt": [f"Summarise {TRIGGER}"]}, "3.7": {"input": [f"Summarise {TRIGGER}"]},
        "6.3": {"tools_json": json.dumps([{"type": "function", "function": {"name": "f", "description": f"Does {TRIGGER}"}}])},
        "sys": {"system": f"Obey {TRIGGER}"},
    }
    messages = {**REFUSED, **PASSED, "3.6": [], "3.7": [], "6.3": user("hello"), "sys": user("hello"), "7.6": user([{"type": "image_url", "image_url": {"url": "x"}}])}
    rows = request_rows(spark, messages, **extra)
    turns = requests.turns(rows)
    texts = requests.request_texts(turns, requests.top_level_texts(rows))
    hits = tripwires.scan(texts.withColumn("norm", normalise(F.col("text"))), "norm")
    first = {r.call_id: r for r in tripwires.first_hit(hits, "call_id", "text_rank").collect()}
    calls = rows.select("call_id", F.lit(True).alias("has_payload"))
    unscannable = {r.call_id for r in requests.unscannable(calls, texts).collect()}
    return first, unscannable


def test_evasions_are_refused(scanned):
    first, _ = scanned
    missed = set(REFUSED) | {"3.6", "3.7", "6.3", "sys"}
    assert missed - set(first) == set()
    assert {first[n].list for n in ("3.3", "6.5")} == {"despaced"}
    assert first["3.1"].list == "sentinel" and first["3.1"].span == "test_sentinel_block_alpha"


def test_ordinary_requests_pass(scanned):
    first, unscannable = scanned
    assert not set(PASSED) & set(first)
    assert unscannable == {"7.6"}


def test_nested_content(spark):
    parts = [{"type": "text", "text": "one"}, "two", {"type": "image_url", "image_url": "x"}, {"type": "input_text", "text": ["three", {"text": "four"}]}, {"type": "odd", "v": ["five"]}, 6, None]
    rows = request_rows(spark, {"object": user({"a": ["x"], "b": "y"}), "flat": user(parts[:3]), "nested": user(parts), "number": user(7)})
    got = {r.call_id: r.text for r in requests.turns(rows).collect()}
    assert got == {"object": "a\nb\nx\ny", "flat": "one\ntwo", "nested": "one\ntwo\nthree\nfour\ntype\nv\nodd\nfive", "number": "7"}


@pytest.mark.parametrize("length,starts", [(0, [0]), (1, [0]), (5399, [0]), (5400, [0]), (5401, [0, 5400]), (6000, [0, 5400]), (10801, [0, 5400, 10800])])
def test_chunk_starts(spark, length, starts):
    row = spark.range(1).select(requests.chunk_starts(F.lit(length)).alias("s"), requests.chunk_count(F.lit(length)).alias("n")).first()
    assert row.s == starts and row.n == len(starts)


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(13_000))
    chunks = requests.chunks(spark.createDataFrame([(1, text), (2, "   ")], "id int, text string")).orderBy("chunk_idx").collect()
    assert {c.id for c in chunks} == {1}
    assert all(text[c.start:c.start + 6000] == c.chunk for c in chunks) and chunks[-1].start + len(chunks[-1].chunk) == len(text)


def test_segment_and_window(spark):
    data = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, 3, "user", "c"), (1, 4, "user", "  "), (2, 0, "assistant", "z")]
    turns = spark.createDataFrame(data, "call_id int, idx int, role string, text string")
    last = {r.call_id: (r.last_idx, r.last_text) for r in requests.last_user_turn(turns).collect()}
    assert last == {1: (3, "c"), 2: (0, "")}
    segment = sorted((r.call_id, r.part, r.idx) for r in requests.new_segment(turns).collect())
    assert segment == [(1, "system", 0), (1, "tail", 3), (1, "tail", 4), (2, "tail", 0)]
    assert {r.call_id for r in requests.conversation_window(turns).collect()} == {1}
    long = spark.createDataFrame([(1, i, "user", str(i)) for i in range(20)], "call_id int, idx int, role string, text string")
    assert sorted(r.idx for r in requests.conversation_window(long).collect()) == list(range(12, 20))


def test_outputs_and_caps(spark):
    choices = [{"index": 0, "message": {"content": "hi", "reasoning": "why", "tool_calls": [{"function": {"name": "f", "arguments": '{"a": "b"}'}}]}}, {"delta": {"content": None, "refusal": "no"}}]
    rows = spark.createDataFrame([("c", json.dumps(choices))], "call_id string, choices_json string")
    assert sorted(r.text for r in outputs.response_texts(rows).collect()) == ["f a\nb", "hi", "no", "why"]
    pieces = [("ok", i, t) for i, t in enumerate("hello")] + [("big", i, "x" * 100_000) for i in range(5)]
    frame = spark.createDataFrame(pieces, "call_id string, seq int, piece string").repartition(3)
    assert sorted((r.call_id, len(r.text)) for r in outputs.assemble(frame, ["call_id"], "seq").collect()) == [("big", 500_000), ("ok", 5)]
    assert [r.call_id for r in outputs.over_caps(frame).collect()] == ["big"]


def test_chunks_of_pieces_equal_chunks_of_the_text(spark):
    sizes = {"a": [3, 50, 7000, 1], "b": [6000], "c": [5399, 1, 700], "long": [90_000] * 5, "d": [1]}
    pieces = [(call, 10 * i, "".join(chr(97 + (k * 7 + i) % 26) for k in range(n))) for call, own in sizes.items() for i, n in enumerate(own)]
    frame = spark.createDataFrame(pieces, "call_id string, at long, text string")
    texts = spark.createDataFrame([(c, "\n".join(t for call, _, t in pieces if call == c)) for c in sizes], "call_id string, text string")
    expected = sorted((r.call_id, r.chunk_idx, r.chunk) for r in requests.chunks(texts).collect())
    for bucket in (15, 1000):
        assert sorted(tuple(r) for r in outputs.assembled_chunks(frame, "call_id", "at", "text", bucket=bucket).select("call_id", "chunk_idx", "chunk").collect()) == expected


def test_large_and_deep_values_are_read_whole(spark):
    wide = [{"type": "other", "nodes": [str(n) for n in range(6000)] + [TRIGGER]}]
    deep = TRIGGER
    for _ in range(60):
        deep = {"d": [deep]}
    rows = [("wide", json.dumps([{"role": "user", "content": wide}])), ("deep", json.dumps([{"role": "user", "content": deep}])), ("broken", "[{"), ("plain", json.dumps(user("hello")))]
    frame = spark.createDataFrame(rows, "call_id string, messages_json string").withColumn("tools_json", F.lit(None).cast("string"))
    assert {r.call_id for r in requests.unreadable(frame).collect()} == {"broken"}
    texts = {r.call_id: r.text for r in requests.request_texts(requests.turns(frame)).where("origin = 'original'").collect()}
    assert TRIGGER in texts["wide"] and "5999" in texts["wide"] and TRIGGER in texts["deep"] and texts["plain"] == "hello"


def test_bodies_of_every_shape(spark):
    texts = {
        1: {"messages": [{"role": "user", "content": "hello"}, "stray", 7, None]},
        2: {"system": [{"type": "text", "text": "be kind"}, {"type": "text", "text": "be brief"}], "prompt": "one line"},
        3: {"prompt": ["a", 5, True, {"k": "v"}], "input": 12},
        4: {"functions": [{"name": "f", "description": "does it"}], "tools": []},
        5: {"prompt": "", "input": [], "system": None, "messages": []},
        6: {"messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "x"}}]}]},
        7: {"messages": "no list", "input": {"a": ["deep", {"b": "er"}]}},
        8: {"system": "plain", "messages": [{"content": "no role"}]},
    }
    rows = [(i, json.dumps(b)) for i, b in texts.items()] + [(9, '{"messages":['), (10, None), (11, "[1]"), (12, "")]
    parts = requests.from_bodies(spark.createDataFrame(rows, "call_id long, body_json string"))
    assert {r.call_id: (r.has_payload, r.readable) for r in parts.collect()} == {
        1: (True, True), 2: (True, True), 3: (True, True), 4: (False, True), 5: (False, True), 6: (True, True), 7: (True, True), 8: (True, True),
        9: (False, False), 10: (False, False), 11: (False, False), 12: (False, False)}
    found = {(r.call_id, r.section, r.idx): r.text for r in requests.body_texts(parts).collect()}
    assert found == {
        (2, "system", 0): "be kind\nbe brief", (2, "prompt", 0): "one line",
        (3, "prompt", 0): "a", (3, "prompt", 1): "5", (3, "prompt", 2): "true", (3, "prompt", 3): "k\nv", (3, "input", 0): "12",
        (4, "functions", 0): "description\nname\ndoes it\nf", (7, "input", 0): "a\ndeep\nb\ner", (8, "system", 0): "plain"}
    assert {(r.call_id, r.idx): (r.role, r.text) for r in requests.turns(parts).collect() if r.text} == {
        (1, 0): ("user", "hello"), (8, 0): ("user", "no role")}
    everything = requests.request_texts(requests.turns(parts), requests.body_texts(parts))
    assert [r.call_id for r in requests.unscannable(parts.where("readable"), everything).collect()] == [6]


@pytest.mark.parametrize("name, steps", [("request_parts", 0), ("request_payloads", 1)])
def test_bodies_are_parsed_once(spark, name, steps):
    from sluiceway.plans import conversation

    plan = getattr(conversation, name)(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == steps and "parseJson" not in plan


def test_one_arrow_step_for_each_section(spark):
    frame = spark.createDataFrame([(1, json.dumps({"prompt": [{"k": "v"}], "tools": [{"name": "f"}]}))], "call_id long, body_json string")
    # The last one is for the structured system text.
    plan = requests.body_texts(requests.from_bodies(frame))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 5
