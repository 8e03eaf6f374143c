"""Streams give what the batch functions give, over several micro-batches."""

import json
import os
import random
import shutil

import pytest
from pyspark.sql.types import _parse_datatype_string

from sluiceway.operators import audit, outputs
from sluiceway.policy import make_policy
from sluiceway.schemas import STREAM_CHUNK, VETO_AUDIT
from sluiceway.session import cut
from sluiceway.streaming import jobs, judged, lockouts, runner, stateful


def write_files(folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read in this order


def chunk(call, seq, content=None, finished=False, **fields):
    return {"call_id": call, "seq": seq, "choice": 0, "content": content, "finished": finished, **fields}


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_gate(spark, tmp_path, order):
    hidden = "test_sentinel_", "block_alpha"
    batches = [
        [chunk("ok", 0, "Hello "), chunk("bad", 0, hidden[0]), chunk("open", 0, "never"), chunk("none", 0, None), chunk("gap", 1, "end", True)]
        + [chunk("long", i, "x" * 100_000) for i in range(3)] + [chunk("tool", 0, tool_idx=0, tool_name="find", tool_args='{"q": "a')]
        + [chunk("two", 0, "fine", choices=2), chunk("two", 1, "", True, choices=2), chunk("two", 2, hidden[0], choice=1, choices=2)],
        [chunk("ok", 2, "!", True), chunk("ok", 1, "world"), chunk("bad", 1, hidden[1], True), chunk("none", 1, " ", True)]
        + [chunk("long", i, "x" * 100_000) for i in range(3, 6)] + [chunk("tool", 1, tool_idx=0, tool_args='b"}', finished=True)]
        + [chunk("two", 3, hidden[1], True, choice=1, choices=2)],
        [chunk("long", 6, "x", True), chunk("ok", 1, "world")],
    ]
    write_files(tmp_path / "in", [batches[k] for k in order])
    stream = runner.follow_log(spark, str(tmp_path / "in"), STREAM_CHUNK, files_per_trigger=1)

    def start(out, checkpoint):
        def handle(batch, batch_id):
            runner.write_batch(stateful.release(cut(batch), make_policy()), out, batch_id)

        return runner.each_batch(stateful.buffer_calls(stream, hold_ms=None), handle, checkpoint)

    rows = runner.run(spark, start, _parse_datatype_string(stateful.RELEASED)).collect()
    got = sorted((r.call_id, r.kind, r.text, r.finish_reason, r.reason) for r in rows)
    withheld = stateful.WITHHELD_TEXT
    # "gap" lacks its first chunk and "open" its end, so neither is released; "two" is judged as a whole.
    assert got == [
        ("bad", "content", withheld, "content_filter", "regex:sentinel"), ("long", "content", withheld, "content_filter", "output_buffer_cap"),
        ("none", "content", withheld, "content_filter", "no_scannable_output"), ("ok", "content", "Hello world!", "stop", None),
        ("tool", "tool", "find q\nab", "stop", None), ("two", "content", withheld, "content_filter", "regex:sentinel"),
    ]


def plain_outcomes(attempts, limit, seconds):
    held, expected = {}, {}
    for a in sorted(attempts, key=lambda a: a["ts_us"]):
        recent = [t for t in held.get(a["account"], []) if a["ts_us"] - t < seconds * 1_000_000]
        if len(recent) >= limit:
            outcome = "refused"
        elif a["failed"]:
            outcome = "failed"
            recent.append(a["ts_us"])
        else:
            outcome, recent = "ok", []
        held[a["account"]] = recent
        expected[a["account"], a["ts_us"]] = outcome
    return expected


@pytest.mark.parametrize("backwards", [False, True])
def test_lockout(spark, tmp_path, backwards):
    rng = random.Random(3)
    times = sorted(rng.sample(range(2000), 200))
    attempts = [{"account": rng.choice(["hot", "hot", "b"]), "ts_us": t * 1_000_000, "failed": rng.random() < 0.8} for t in times]
    parts = [attempts[:70], attempts[70:130], attempts[130:]]
    for part in parts:
        rng.shuffle(part)
    write_files(tmp_path / "in", parts[::-1] if backwards else parts)
    stream = runner.follow_log(spark, str(tmp_path / "in"), lockouts.OPEN, files_per_trigger=1)
    # Files in order need no delay; against it, attempts stay open as long as files may be late.
    job = lockouts.LockoutJob(spark, str(tmp_path / "work"), str(tmp_path / "out"), 3, 60, 2_000_000_000 if backwards else 0)
    runner.each_batch(stream, job.handle, str(tmp_path / "checkpoint")).awaitTermination()
    job.close()
    rows = spark.read.schema(lockouts.ATTEMPTS).parquet(str(tmp_path / "out")).collect()
    expected = plain_outcomes(attempts, 3, 60)
    assert len(rows) == 200 and {(r.account, r.ts_us): r.outcome for r in rows} == expected and "refused" in expected.values()
    left = spark.read.schema(lockouts.STATE).parquet(str(tmp_path / "work" / "state")).collect()
    assert all(len(r.failures) <= 3 for r in left)


def test_alerts_and_scan(spark, tmp_path):
    log = [{"ts": "2024-01-01T00:00:00", "stage": "pre_call", "reason": r, "detail": d, "call_id": str(i)} for i, (r, d) in enumerate([("classifier", "S1 Violent Crimes"), ("classifier", "S13 Elections"), ("regex:extra", "p")])]
    write_files(tmp_path / "log", [log[:2], log[2:]])
    stream = runner.follow_log(spark, str(tmp_path / "log"), VETO_AUDIT, files_per_trigger=1)
    got = runner.run(spark, lambda out, ckpt: runner.to_table(jobs.alert_stream(stream), out, ckpt), _parse_datatype_string("call_id string, alert string"))
    batch = audit.alerts(spark.read.schema(VETO_AUDIT).json(str(tmp_path / "log")))
    assert sorted(got.collect()) == sorted(batch.collect()) and batch.count() == 2

    policy_file = tmp_path / "policy.json"
    policy_file.write_text(json.dumps({"tripwires": {"extra_patterns": ["forbidden"]}}))
    write_files(tmp_path / "texts", [[{"call_id": "a", "text": "Forbidden fruit"}], [{"call_id": "b", "text": "fine"}]])
    texts = runner.follow_log(spark, str(tmp_path / "texts"), "call_id string, text string", files_per_trigger=1)
    watch = runner.PolicyWatch(spark, str(policy_file))
    rows = runner.run(spark, lambda out, ckpt: jobs.scan_stream(texts, watch, out, ckpt), _parse_datatype_string(jobs.SCAN_SCHEMA))
    assert [tuple(r) for r in rows.collect()] == [("a", "regex:extra", "forbidden", "forbidden")]
    policy_file.write_text("{")
    assert watch.current().extra_patterns == ("forbidden",)


def test_assembled_stream_equals_batch(spark):
    pieces = spark.createDataFrame([("a", 0, 2, "b"), ("a", 0, 1, "a"), ("a", 1, 1, "z")], "call_id string, choice int, seq int, piece string")
    got = sorted((r.choice, r.text) for r in outputs.assemble(pieces, ["call_id", "choice"], "seq").collect())
    assert got == [(0, "ab"), (1, "z")]
    assert stateful._assemble([[2, 0, "content", -1, "b"], [1, 0, "content", -1, "a"], [1, 1, "content", -1, "z"]]) == [
        {"choice": 0, "kind": "content", "text": "ab"}, {"choice": 1, "kind": "content", "text": "z"}
    ]


ANSWERS = "call_id STRING, part_idx INT, model STRING, raw STRING, judged_at TIMESTAMP"


def test_judged_release(spark, tmp_path):
    """Late, missing, repeated, unreadable and blocked verdicts, calls of several parts, over several micro-batches."""
    minute = lambda m: f"2024-01-01T00:{m:02d}:00.000Z"
    far = "2024-01-02T00:00:00.000Z"

    def call(name, m, text="words", reason=None):
        outputs_ = [] if reason else [{"choice": 0, "kind": "content", "text": text}]
        return {"call_id": name, "reason": reason, "chunks": 1, "chars": len(text), "ended_at": minute(m), "outputs": outputs_}

    def answer(name, m, raw="safe", part=0, model="llama-guard"):
        return {"call_id": name, "part_idx": part, "model": model, "raw": raw, "judged_at": minute(m)}

    long = "w " * 40
    calls = [
        [call("ok", 0), call("late", 0), call("missing", 1), call("blocked", 1), call("allowed", 1), call("mixed", 2)],
        [call("unread", 3), call("capped", 3, reason="output_buffer_cap"), call("hit", 3, "test_sentinel_block_alpha"), call("long", 4, long), call("half", 4, long), call("foreign", 4)],
        [{"call_id": "", "ended_at": far}],
    ]
    answers = [
        [answer("ok", 1), answer("ok", 1), answer("blocked", 2, "unsafe\nS1"), answer("allowed", 2, "unsafe\nS13"), answer("mixed", 2), answer("mixed", 3, "unsafe\nS1,S9"), answer("nobody", 2)],
        [answer("late", 11), answer("unread", 4, "hm"), answer("hit", 4), answer("half", 5), answer("foreign", 5, model="other")] + [answer("long", 5, part=k) for k in range(5)],
        [{"call_id": "", "part_idx": 0, "judged_at": far}],
    ]
    write_files(tmp_path / "calls", calls)
    write_files(tmp_path / "answers", answers)
    held, told = (runner.follow_log(spark, str(tmp_path / n), schema, files_per_trigger=1) for n, schema in (("calls", stateful.BUFFERED), ("answers", ANSWERS)))
    policy = make_policy()
    seen = []

    def start(out, checkpoint):
        def handle(batch, batch_id):
            rows = cut(batch.where("call_id <> ''"))
            seen.extend((r.call_id, r.parts) for r in rows.collect())
            runner.write_batch(stateful.release(rows, policy), out, batch_id)

        return runner.each_batch(judged.judge(held, told, policy, "10 minutes", "1 minute", size=20, overlap=4), handle, checkpoint)

    rows = runner.run(spark, start, _parse_datatype_string(stateful.RELEASED)).collect()
    assert {r.call_id: r.reason for r in rows} == {
        "ok": None, "allowed": None, "long": None, "late": "guard_unavailable", "missing": "guard_unavailable", "half": "guard_unavailable", "blocked": "classifier",
        "mixed": "classifier", "unread": "guard_verdict_unparseable", "capped": "output_buffer_cap", "hit": "regex:sentinel", "foreign": "guard_no_adapter"}
    assert len(rows) == 12 and {r.text for r in rows if r.reason} == {stateful.WITHHELD_TEXT} and {r.call_id: r.text for r in rows}["long"] == long
    assert len(seen) == 12 and dict(seen)["long"] == 5  # 80 characters, a part every 16


def test_late_chunk_after_time_out(spark):
    """A released or timed-out call stays marked: what comes later is swallowed and never a second row."""
    import pandas as pd

    class State:
        exists, hasTimedOut, value, ms = False, False, None, None
        get = property(lambda self: self.value)

        def update(self, value):
            self.value, self.exists = value, True

        def setTimeoutDuration(self, ms):
            self.ms = ms

        def remove(self):
            self.value, self.exists = None, False

    def feed(state, *rows):
        state.hasTimedOut = False
        frame = pd.DataFrame([{**dict.fromkeys(("reasoning", "tool_idx", "tool_name", "tool_args", "at")), **r} for r in rows])
        return [r for out in stateful._hold(("c",), iter([frame]), state, 1000, 5000) for r in out.to_dict("records")]

    def expire(state):
        state.hasTimedOut = True
        return [r for out in stateful._hold(("c",), iter([]), state, 1000, 5000) for r in out.to_dict("records")]

    state = State()
    assert feed(state, chunk("c", 0, "a")) == [] and state.ms == 1000
    assert [r["reason"] for r in expire(state)] == ["stream_timeout"] and state.ms == 5000
    assert feed(state, chunk("c", 1, "b", True)) == [] and feed(state, chunk("c", 0, "a")) == [] and state.ms == 5000
    assert expire(state) == [] and not state.exists
    state = State()
    assert [r["reason"] for r in feed(state, chunk("c", 0, "a", True))] == [None] and state.ms == 5000
    assert feed(state, chunk("c", 1, "late", True)) == [] and expire(state) == [] and not state.exists


def test_alerts_once(spark, tmp_path):
    """Files come again in later micro-batches; late records alert, old copies do not, and a record without a time always does."""
    def record(call, ts, reason="regex:csam"):
        return {"ts": ts, "stage": "pre_call", "reason": reason, "detail": "p", "call_id": call, "model": "m", "key_alias": "k"}

    first = [record("a", "2024-05-01T10:00:00+00:00"), record("b", "2024-05-01T11:00:00+00:00"), record("a", "2024-05-01T10:00:00+00:00")]
    second = [record("c", "2024-05-03T10:00:00+00:00"), record("late", "2024-05-01T09:00:00+00:00"), record("a", "2024-05-01T10:00:00+00:00", "guard_unavailable")]
    write_files(tmp_path / "log", [first, second, first, second, [record("untimed", "soon")], [record("quiet", "2024-05-03T10:00:00+00:00", "regex:sentinel")]])
    stream = runner.follow_log(spark, str(tmp_path / "log"), VETO_AUDIT, files_per_trigger=1)
    got = runner.run(spark, lambda out, ckpt: runner.to_table(jobs.alerts_once(stream), out, ckpt), _parse_datatype_string("call_id string, alert string"))
    assert sorted(r.call_id for r in got.collect()) == ["a", "a", "b", "c", "late", "untimed"]


@pytest.mark.parametrize("folder", [False, True])
def test_streams_of_files_and_folders(spark, tmp_path, folder):
    """A shared table is one file or a folder of files; a stream of either gives the rows of its SQL, and none from an empty folder."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    turns = [(c, t, role, f"mail me: user{c}@mail.example" if c % 3 == 0 else f"words {c} {t}") for c in range(20) for t, role in ((0, "user"), (1, "assistant"))]
    tables = {
        "documents": ([(2 * c + t, text) for c, t, _, text in turns], "doc_id long, text string"), "conversations": (turns, "conv_id long, turn long, role string, text string"),
        "labels": ([(c, c % 2, int(c % 5 == 0)) for c in range(18)], "doc_id long, quality long, toxic long"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        if not folder:
            (part,) = (tmp_path / f"{name}.parquet").glob("*.parquet")
            part.rename(tmp_path / "one")
            shutil.rmtree(tmp_path / f"{name}.parquet")
            (tmp_path / "one").rename(tmp_path / f"{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet{'/*.parquet' if folder else ''}'")
    for name in ("stream_scan", "stream_gate", "stream_gate_judged"):
        got = queries()[name](spark, str(tmp_path))
        expected = con.sql(oracle_sql()[name]).df()[got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(expected.itertuples(index=False, name=None)) and len(expected) > 5, name

    if folder:
        spark.createDataFrame([], tables["documents"][1]).write.parquet(f"{tmp_path}/none/documents.parquet")
        assert queries()["stream_scan"](spark, f"{tmp_path}/none").count() == 0


def test_gates_of_long_conversations(spark, tmp_path, monkeypatch):
    """Turns from the 20th on have their label's answers, turn 100 of a conversation is not turn 0 of the next, far times come too, and the join keeps answers on
    turns that there are alone."""
    import duckdb
    from __spark_entry__ import oracle_sql, queries

    odd = 'say "x"\\\n\t \x01\U0001f600 é'
    turns = [(c, t, role, f"{odd} {c} {t}") for c, n in ((1, 130), (2, 40), (2_000_000, 2)) for t in range(n) for role in ("user" if t % 2 else "assistant",)]
    tables = {"conversations": (turns, "conv_id long, turn long, role string, text string"), "labels": ([(c, 1, int(c == 2)) for c in (1, 2, *range(50, 80), 2_000_000)], "doc_id long, quality long, toxic long")}
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    started, each_batch = [], runner.each_batch
    monkeypatch.setattr(runner, "each_batch", lambda *a: started.append(each_batch(*a)) or started[-1])
    for name in ("stream_gate", "stream_gate_judged"):
        got = queries()[name](spark, str(tmp_path))
        expected = con.sql(oracle_sql()[name]).df()[got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(expected.itertuples(index=False, name=None)) and len(expected) == 86, name
    assert {r.reason for r in expected.itertuples()} == {"", "classifier"}
    (join,) = [o for o in started[-1].recentProgress[0]["stateOperators"] if o["operatorName"] == "symmetricHashJoin"]
    assert join["numRowsTotal"] <= 2 * 86 + 2  # the feeds' last rows
