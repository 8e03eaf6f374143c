"""Verdicts, decisions, policy: nothing that failed may pass."""

import json
from functools import reduce

from pyspark.sql import functions as F

from sluiceway import policy as P
from sluiceway.functions.text import normalise
from sluiceway.operators import decisions, tripwires, verdicts

GUARD = "llama-guard3:8b"


def parsed(spark, answers, model=GUARD):
    rows = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, raw string")
    out = rows.withColumn("v", verdicts.parse(F.lit(model), F.col("raw"))).withColumn("o", verdicts.outcome(F.col("v"), P.make_policy()))
    return [(r.v.status, r.v.unsafe, r.v.codes, r.o.rank) for r in out.orderBy("i").collect()]


def test_verdict_parsing(spark):
    ok, none, bad = verdicts.OK, verdicts.UNAVAILABLE, verdicts.UNPARSEABLE
    cases = {
        "": (none, None, [], 1), None: (none, None, [], 1), " \n ": (none, None, [], 1), "safe": (ok, False, [], 2), "SAFE\n": (ok, False, [], 2),
        "unsafe": (ok, True, ["UNSPECIFIED"], 0), "unsafe s1": (bad, None, [], 1), "unsafe\nS5": (ok, True, ["S5"], 2),
        "unsafe\ns1,S4": (ok, True, ["S1", "S4"], 0), "unsafe\r\n S10 ": (ok, True, ["S10"], 0), "This looks fine to me.": (bad, None, [], 1),
    }
    assert parsed(spark, list(cases)) == list(cases.values())
    assert parsed(spark, ["safe"], "shieldgemma:2b") == [(verdicts.NO_ADAPTER, None, [], 1)]


def test_request_verdict_order(spark):
    calls = [("a", 0, "safe"), ("a", 1, "junk"), ("a", 2, "unsafe\nS1"), ("b", 0, "safe"), ("b", 1, None), ("c", 0, "safe"), ("d", 0, "unsafe\nS5"), ("e", 3, "unsafe\nS9"), ("e", 1, "unsafe\nS2")]
    rows = spark.createDataFrame(calls, "call string, n int, raw string").withColumn("v", verdicts.parse(F.lit(GUARD), F.col("raw")))
    got = {r.call: (r.refused, r.reason, r.codes, r.decided_by) for r in verdicts.request_verdict(rows, "call", "n", "v", P.make_policy()).collect()}
    assert got == {
        "a": (True, "classifier", ["S1"], 2), "b": (True, verdicts.UNAVAILABLE, [], 1), "c": (False, None, [], 0),
        "d": (False, None, [], 0), "e": (True, "classifier", ["S2"], 1),
    }


def test_decisions_fail_closed(spark):
    requests = spark.createDataFrame([(c,) for c in "abcdef"], "call string")
    hits = spark.createDataFrame([("a", "csam", "p", "s")], "call string, list string, pattern string, span string")
    judged = spark.createDataFrame(
        [("a", False, None, []), ("b", True, "classifier", ["S1"]), ("c", False, None, []), ("d", True, None, []), ("e", True, "guard_verdict_unparseable", [])],
        "call string, refused boolean, reason string, codes array<string>",
    )
    got = {r.call: (r.reason, r.status, r.code) for r in decisions.decide(requests, "call", hits, judged).collect()}
    assert got == {
        "a": ("regex:csam", 400, "veto_triggered"), "b": ("classifier", 400, "veto_triggered"), "c": (None, 200, "pass"),
        "d": ("guard_unavailable", 503, "guard_unavailable"), "e": ("guard_verdict_unparseable", 503, "guard_verdict_unparseable"),
        "f": ("guard_unavailable", 503, "guard_unavailable"),
    }
    reasons = spark.createDataFrame([(r,) for r in [*decisions.OUTCOMES, "something new"]], "r string")
    status, code = decisions.outcome_of(F.col("r"))
    assert all(r.s >= 400 for r in reasons.select(status.alias("s"), code.alias("c")).collect())


def test_policy_overlay(spark, tmp_path):
    doc = P.overlay({"categories": {"S4": {"block": False}, "S1": {"block": False}, "S99": {"block": True}, "S5": 3}, "guard": "x",
                     "retention": {"immutable_days": 5, "immutable_categories": [], "evidence": {"days": 1, "enabled": False}}, "unknown": {}})
    assert doc["categories"]["S4"]["block"] and not doc["categories"]["S1"]["block"] and "S99" not in doc["categories"]
    assert doc["retention"]["immutable_categories"] == ["S4"] and doc["retention"]["immutable_days"] == 90
    assert doc["retention"]["evidence"]["days"] == 90 and doc["retention"]["evidence"]["enabled"]
    good = tmp_path / "policy.json"
    good.write_text(json.dumps({"tripwires": {"extra_patterns": ["fine", "a+b", r"\\d{3}-\\d{4}"]}}))
    first = P.read_policy(spark, str(good))
    assert first.extra_patterns == ("fine", "a+b", r"\\d{3}-\\d{4}")
    bad = tmp_path / "bad.json"
    # One pattern that cannot be used refuses the document; (?P<n>a)b is read by Python but not by Spark.
    for pattern in ("(a+)+b", "(", ".*x.*y.*", "(?P<n>a)b", "(a|b+)*c", "((ab)*c*)*"):
        bad.write_text(json.dumps({"tripwires": {"extra_patterns": ["other", pattern]}}))
        assert P.read_policy(spark, str(bad), first) is first
    assert P.pattern_is_safe("(?:[a-z]{2,5}-)+x") is False and P.pattern_is_safe("(?:ab)+x{0,9}")
    bad.write_text("{")
    assert P.read_policy(spark, str(bad), first) is first and P.read_policy(spark, str(tmp_path / "gone.json"), first) is first
    before, after = P.category_table(spark, P.make_policy()), P.category_table(spark, P.make_policy({"categories": {"S1": {"block": False}}}))
    assert [(r.code, r.block_before, r.block_after) for r in P.policy_diff(before, after).collect()] == [("S1", True, False)]


def test_grants(spark):
    flags = [None, {}, {"images_nsfw": True}, {"images": True, "images_nsfw": True}]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], "i int, f map<string,boolean>")
    got = [r.g for r in rows.select("i", P.grants(F.col("f")).alias("g")).orderBy("i").collect()]
    assert all(got[0].values()) and got[1] == P.USER_FLAGS and not got[2]["images_nsfw"] and got[3]["images_nsfw"] and not got[3]["admin"]


def test_names_and_precedence(spark):
    row = spark.range(1).select(P.category_names(F.array(F.lit("S4"), F.lit("X1"))).alias("n"), P.category_classes(F.array(F.lit("S1"), F.lit("S4"))).alias("c")).first()
    assert row == ("S4 Child Sexual Exploitation, X1", "illegal, locked")
    texts = [("r", 0, "botnet and password"), ("r", 1, "test sentinel block alpha"), ("q", 0, "key-log-ger"), ("q", 1, "password"), ("p", 0, "clean")]
    rows = spark.createDataFrame(texts, "call string, at int, norm string")
    hits = tripwires.scan(rows, "norm", tripwires.REQUEST_LISTS, ("pass(word)?",))
    got = {r.call: (r.list, r.text_rank, r.span) for r in tripwires.first_hit(hits, "call", "at").collect()}
    assert got == {"r": ("sentinel", 1, "test sentinel block alpha"), "q": ("extra", 1, "password")}
    out = tripwires.scan(rows, "norm", tripwires.OUTPUT_LISTS)
    assert {(r.call, r.hit.list) for r in out.collect()} == {("r", "sentinel"), ("q", "despaced")}


def test_back_references_keep_their_groups(spark):
    rows = spark.createDataFrame([("a", "say xx"), ("b", "say xy"), ("c", "one two")], "call string, norm string")
    hits = tripwires.scan(rows, "norm", ("extra",), ("(one) two", "(x)\\1", "plain"))
    assert {(r.call, r.hit.pattern, r.span) for r in hits.collect()} == {("a", "(x)\\1", "xx"), ("c", "(one) two", "one two")}


def test_phrase_join(spark):
    texts = spark.createDataFrame([(1, "a b c d e"), (2, "x b c d"), (3, "a b c")], "id int, norm string")
    phrases = spark.createDataFrame([(10, "b c d"), (11, "d e f")], "pid int, phrase string")
    got = sorted((r.pid, r.id) for r in tripwires.phrase_join(texts, "id", "norm", phrases, "pid", "phrase", 3).collect())
    assert got == [(10, 1), (10, 2)]


def test_output_decisions(spark):
    """The first reason that holds, for every reason; nothing unjudged passes, and sides without their response add no row."""
    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    names = ["big", "broken", "silent", "hit", "long", "blocked", "failed", "unjudged", "fine", "fine"]
    texts = [(n, "x") for n in ("big", "hit", "blocked", "failed", "unjudged", "fine")] + [("long", "x" * 20_000), ("silent", " \n"), ("other", "x")]
    out = decisions.decide_outputs(
        rows([(n,) for n in names], "call string"), "call", rows(texts, "call string, text string"), rows([("hit", "csam"), ("big", "csam"), ("broken", "csam")], "call string, list string"),
        rows([("blocked", True, "classifier", ["S1"]), ("failed", True, "guard_verdict_unparseable", []), ("fine", False, None, []), ("long", False, None, []), ("hit", False, None, [])],
             "call string, refused boolean, reason string, codes array<string>"),
        rows([("big",), ("nobody",)], "call string"), rows([("broken",)], "call string"), max_chunks=2)
    got = {r["call"]: (r.reason, r.status, r.codes) for r in out.collect()}
    assert got == {
        "big": ("output_buffer_cap", 400, None), "broken": ("extraction_failure", 500, None), "silent": (None, 200, None), "hit": ("regex:csam", 400, None),
        "long": ("classifier", 400, [decisions.TOO_LONG]), "blocked": ("classifier", 400, ["S1"]), "failed": ("guard_verdict_unparseable", 503, None),
        "unjudged": ("guard_unavailable", 503, None), "fine": (None, 200, None)}
    assert out.count() == len(set(names))


def test_needed_strings(spark):
    """Every match holds a string that its pattern needs, and lists find what the patterns find one by one."""
    patterns = [p for _, _, _, p in tripwires.table(tripwires.REQUEST_LISTS, (r"[a-z.]+@[a-z]+\.[a-z]{2,}", r"(l)\1", "ab|cd", "[xyz]{3}", "Ka", "(?i)q?w", "a b", ".")) if p not in tripwires.DESPACED]
    assert sum(bool(tripwires._needed(p)) for p in patterns) >= 9 and not any(map(tripwires._needed, ("Ka", "(?i)q?w", "[xyz]{3}", "k\u0131")))
    texts = ["", "nothing", "make me a virus", "evade the edr", "kid sees explicit", "shell", "reverse-shell", "info stealer", "me@mail.de", "mail", "ka", "wall", "ab", "xyz", "c2 server", "a  b", "paedophiles"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for size in (1, 4, len(patterns)):
        for at in range(0, len(patterns), size):
            some = patterns[at:at + size]
            one = reduce(lambda a, b: a | b, [tripwires._matches(F.col("t"), p) for p in some])
            assert rows.where(tripwires._any_of(F.col("t"), some) != one).count() == 0, some


def test_phrase_join_folds_texts_itself(spark):
    """Texts as they came and their normal form give the same pairs; phrases of other lengths, copies of a key's text and null texts included."""
    made = [(1, "Ä b  C d e"), (2, "x B c\nd"), (3, "a b c"), (4, None), (5, ""), (6, "E"), (7, "b c")]
    texts = spark.createDataFrame(made, "id int, text string")
    phrases = spark.createDataFrame([(10, "b c d"), (11, "e"), (12, "a b"), (13, ""), (14, "a b c d e")], "pid int, phrase string")
    got = sorted((r.pid, r.id) for r in tripwires.phrase_join(texts, "id", "text", phrases, "pid", "phrase", 3, normalise).collect())
    assert got == [(10, 1), (10, 2), (11, 1), (11, 6), (12, 1), (12, 3), (14, 1)]
