"""The regex join against Python's own matching of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sluiceway.operators import regex_index as X


@pytest.mark.parametrize("pattern, found", [
    ("ignore all", [{"ignore all"}]), ("a(?:bcde|fghij)k", [{"bcde", "fghij"}]), ("(?:abcd|x)", []), ("a.b.c", []), ("foo(?:bar)+baz", [{"foobar"}]),
    ("Kilo\\b gram", [{"kilo gram"}]), ("x{5}yz", [{"xxxxxyz"}]), ("(?:abcd){0,2}wxyz", [{"wxyz"}]), ("ab(cd)ef", [{"abcdef"}]), ("straße wide", [{"e wide"}, {"stra"}]),
    ("longſt", [{"longst"}]), ("one(?=two)thr", [{"onethr"}]), ("(ab|cd){2,3}xyzw", [{"xyzw"}]), ("", []), ("first.*(?:other|second one).+last", [{"first"}, {"other", "second one"}, {"last"}]),
    ("aaaa.bbbbb.cccccc.ddddddd", [{"ddddddd"}, {"cccccc"}, {"bbbbb"}]),
])
def test_factors(pattern, found):
    assert X.factors(pattern) == found


def test_factors_are_required():
    rng = random.Random(4)

    def some(depth):
        kind = rng.randrange(7 if depth else 2)
        if kind < 2:
            return "".join(rng.choices("abcAB", k=rng.randint(1, 6)))
        if kind == 2:
            return f"(?:{some(depth - 1)}|{some(depth - 1)})"
        if kind == 3:
            return f"({some(depth - 1)}){rng.choice(['?', '+', '*', '{2}', '{1,3}'])}"
        if kind == 4:
            return rng.choice([".", "[ab]", "[^c]", r"\w"])
        return some(depth - 1) + some(depth - 1)

    matched = 0
    for _ in range(1500):
        pattern = some(3)
        needed = X.factors(pattern)
        for _ in range(5):
            text = "".join(rng.choices("abcABx", k=60))
            m = re.search(pattern, text, re.I | re.S)
            if m and needed:
                matched += 1
                assert all(any(f in m.group(0).translate(X.FOLD) for f in own) for own in needed), (pattern, needed, m.group(0))
    assert matched > 100


@pytest.mark.parametrize("block", [1, 100])
def test_join_equals_all_pairs(spark, block):
    rng = random.Random(block)
    words = ["alpha", "BETA", "gamma", "delta", "42", "kılo", "Kelvin", "end.", "ſix"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9)))) for i in range(120)] + [(200, None), (201, ""), (202, "two\nlines alpha"), (3, "alpha beta")]
    patterns = [(1, "alpha.*delta"), (2, "(?:beta|gamma) [0-9]+"), (3, "kelvin"), (4, "six"), (5, "a"), (6, r"(l)\1"), (7, "lines|nothing"), (8, None), (9, "kilo"), (1, "never here"), (10, r"\bend\b")]
    frames = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(patterns, "id long, pattern string")
    joined = X.regex_join(frames[0], "doc", "text", frames[1], "id", "pattern", block)
    rows = [(r.id, r.doc) for r in joined.collect()]
    expected = {(i, d) for i, p in patterns if p for d, t in texts if t is not None and re.search(p, t, re.I | re.S)}
    assert len(rows) == len(set(rows)) and set(rows) == expected and {i for i, _ in rows} >= {1, 2, 3, 4, 5, 7, 10}
    plan = joined._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("pattern, found", [
    ("alpha[ \n]+beta[ \n,.]+(?:gamma|delta)", [{("alph", "beta")}, {("beta", "gamm"), ("beta", "delt")}]), ("(?:alph|beta)[a-z]+ delt", [{("alph", "delt"), ("beta", "delt")}]),
    (r"\babcd\b, efgh(?:ij|)k", [{("abcd", "fghk"), ("abcd", "hijk")}]), ("abcd *efgh", []), ("abcd[ ]+(?:s|)[ ]+efgh", []), ("abcd[a ]efgh", []), ("abcd[^ ]efgh", []),
    (r"abcd\s+efgh", []), ("abcd( +)efgh", [{("abcd", "efgh")}]), ("abcd[ ]{0,2}efgh", []), ("abcd. efgh", []), ("abcd -[.]+efgh", [{("abcd", "efgh")}]), ("abcd \u00e9 efgh", []),
])
def test_pairs(pattern, found):
    expected = [{(X._gram(one), X._gram(other)) for one, other in own} for own in found]
    assert sorted(map(sorted, X.pairs(pattern))) == sorted(map(sorted, expected))


def test_pairs_leave_few_candidates(spark):
    """Texts that hold all factors of a pattern, but not side by side, do not reach the expression; those that match do, whatever case and characters stand around."""
    made = ["alphax delta", "ALPHAX  beta,.GAMMA", "alpha\nbeta delta", "ſalpha beta. gamma", "alphaK delta", "éalpha betaé", "beta alpha gamma delta", "alpha beta", "alpha", "al pha"]
    texts = spark.createDataFrame(list(enumerate(made)), "doc long, text string")
    patterns = {1: "alpha[ \n]+beta[ \n,.]+(?:gamma|delta)", 2: "(?:alpha|betagamma)[a-z]+ delta", 3: "alpha +beta", 4: "lphax +(?:delt|beta)"}
    table = spark.createDataFrame(list(patterns.items()), "id long, pattern string")
    got = {(r.id, r.doc) for r in X.regex_join(texts, "doc", "text", table, "id", "pattern").collect()}
    assert got == {(i, d) for i, p in patterns.items() for d, t in enumerate(made) if re.search(p, t, re.I | re.S)} and len(got) >= 7
    numbers = [n for p in patterns.values() for own in X.sought(p) for n in own]
    slots = spark.createDataFrame([(n,) for n in numbers], "n long").select(F.explode(X.Wanted.slots(F.col("n"))).alias("s")).select("s.*").collect()
    held = {r.doc: r.g for r in texts.select("doc", X.text_grams(F.col("text"), X.Wanted([tuple(r) for r in slots])).alias("g")).collect()}
    assert held[8] == held[9] == [] and len(held[2]) == 2
