"""Members of nested documents against a walk in plain Python."""

import json
import random

from sluiceway.operators import json_tree


def walk(value, path="$", name=None):
    """(path, name, text) depth first, the members of an object by name."""
    text = value if isinstance(value, str) else None
    if name is not None or text is not None:
        yield path, name, text
    if isinstance(value, dict):
        for key in sorted(value, key=lambda k: k.encode()):
            plain = key.isascii() and key.replace("_", "a").isalnum()
            step = f".{key}" if plain else '."' + key.replace("\\", "\\\\").replace('"', '\\"') + '"'
            yield from walk(value[key], path + step, key)
    elif isinstance(value, list):
        for i, item in enumerate(value):
            yield from walk(item, f"{path}[{i}]")


def grow(rng, depth):
    roll = rng.random()
    if depth == 0 or roll < 0.3:
        return rng.choice(["a text", "", "é\n\"q\"", 7, 1.5, True, None])
    if roll < 0.6:
        return [grow(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["k", "a b", 'x"y', "ü", "text", "back\\slash", "n_1", "7", ""]): grow(rng, depth - 1) for _ in range(rng.randrange(5))}


def test_members_equal_walk(spark):
    rng = random.Random(3)
    documents = {i: grow(rng, rng.randrange(7)) for i in range(120)}
    documents[900] = {"a": [[[[[[[[{"deep": ["x"] * 300}]]]]]]]]}
    rows = [(i, json.dumps(d, ensure_ascii=i % 2 == 0)) for i, d in documents.items()]
    got = {}
    for r in sorted(json_tree.members(spark.createDataFrame(rows, "id long, doc string"), "id", "doc").collect(), key=lambda r: (r.id, r["at"])):
        got.setdefault(r.id, []).append((r.path, r.name, r.text))
    assert got == {i: found for i, d in documents.items() if (found := list(walk(d)))}


def test_unreadable_repeated_and_empty(spark):
    rows = [(1, None), (2, "{"), (3, '{"a": 1, "a": 2}'), (4, "{}"), (5, '"bare"'), (6, '["s"]'), (6, '["s"]'), (7, ""), (8, "null")]
    frame = spark.createDataFrame(rows, "value long, doc string")  # a key column named like one of the table function's
    got = sorted((r["value"], r.path or "", r.text or "") for r in json_tree.members(frame, "value", "doc").collect())
    assert got == [(1, "", ""), (2, "", ""), (3, "", ""), (5, "$", "bare"), (6, "$[0]", "s"), (6, "$[0]", "s"), (7, "", "")]
    assert json_tree.members(frame.limit(0), "value", "doc").count() == 0


def test_plan_has_no_python(spark):
    frame = spark.createDataFrame([(1, '{"a": ["b"]}')], "id long, doc string")
    plan = json_tree.members(frame, "id", "doc")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
