"""Audit, retention, evidence, sources and sinks."""

import json

from pyspark.sql import functions as F

from sluiceway.operators import audit, evidence, reports, retention
from sluiceway.policy import make_policy
from sluiceway.sources import readers, writers
from sluiceway.streaming import jobs

VETO = "ts string, stage string, reason string, detail string, call_id string, model string, key_alias string, device_fingerprint string"


def veto(reason, detail, call="c", ts="2024-01-01T00:00:00+00:00"):
    return (ts, "pre_call", reason, detail, call, "m", "k", None)


def test_records_and_flags(spark):
    rows = [veto("classifier", "S4 Child Sexual Exploitation"), veto("regex:sentinel", "x"), veto("regex:csam", "p"), veto("classifier", "S10 Hate"),
            veto("guard_verdict_unparseable", "a\n" * 200), veto("classifier", "z" * 130 + " S4"), veto("classifier", None)]
    got = [(r.immutable, r.evidence_id is not None, len(r.detail)) for r in audit.records(spark.createDataFrame(rows, VETO).coalesce(1), make_policy()).collect()]
    assert got == [(True, True, 28), (False, False, 1), (True, True, 1), (True, False, 8), (False, False, 600), (True, True, 133), (False, False, 0)]


def test_alert_tokens(spark):
    cases = {("classifier", "S1 Violent Crimes"): True, ("classifier", "S10 Hate"): True, ("classifier", "S1"): False, ("classifier", "S13 Elections"): False,
             ("regex:extra", "p"): True, ("regex:sentinel", "S1 x"): False, ("guard_unavailable", ""): True, ("classifier", "UNSPECIFIED"): False}
    rows = spark.createDataFrame([(*k, i) for i, k in enumerate(cases)], "reason string, detail string, i int").orderBy("i")
    assert [r.a for r in rows.select(audit.is_alert(F.col("reason"), F.col("detail")).alias("a")).collect()] == list(cases.values())


def test_snippets(spark):
    rows = spark.createDataFrame([(*veto("classifier", d), "  " + "t" * 200) for d in ("S4 x", "S5 y")] + [(*veto("regex:csam", "p"), "t"), (*veto("regex:despaced", "p"), "t")], VETO + ", text string")
    assert audit.snippets(rows, make_policy()).count() == 0
    kept = audit.snippets(rows, make_policy({"audit": {"store_snippet": True}})).collect()
    assert [(r.detail, len(r.snippet)) for r in kept] == [("S5 y", 160)]


def test_client_fields(spark):
    a = {"X-Forwarded-For": " 1.2.3.4 , 5.6.7.8", "X-Device-Fingerprint": "AB" * 32, "User-Agent": "one"}
    b = {"user-agent": "two", "x-real-ip": "9.9.9.9"}
    empty = {"x-device-fingerprint": audit.EMPTY_FINGERPRINT, "x-real-ip": "9.9.9.9"}
    rows = spark.createDataFrame([(0, a, b), (1, None, empty)], "i int, p map<string,string>, m map<string,string>")
    got = [tuple(r.c) for r in rows.select(audit.client_fields(F.col("p"), F.col("m")).alias("c"), "i").orderBy("i").collect()]
    assert got == [("1.2.3.4", "two", "ab" * 32, None), ("9.9.9.9", None, None, None)]


def test_page_clamps(spark):
    log = spark.range(60).withColumnRenamed("id", "ts")
    order = [F.col("ts").desc()]
    assert [r.ts for r in audit.page(log, order, per=7, number=99).collect()] == list(range(9, -1, -1))
    assert audit.page(log, order, per=50, number=0).first().page == 1


def test_log_round_trip_and_quarantine(spark, tmp_path):
    log = tmp_path / "log"
    rows = audit.records(spark.createDataFrame([veto("classifier", "S4 x"), veto("regex:extra", "y", "d", "2024-01-02T00:00:00+00:00")], VETO), make_policy())
    writers.append_log(rows, str(log))
    writers.append_log(rows, str(log))
    assert sorted(p.name for p in log.glob("dt=*")) == ["dt=2024-01-01", "dt=2024-01-02"]
    (log / "dt=2024-01-02" / "extra.json").write_text('{"ts": "2024-01-02T01:00:00+00:00", "reason": "r"}\nnot json\n')
    good, bad = readers.split_log(readers.read_log(spark, str(log)))
    assert good.count() == 5 and [r.line for r in bad.collect()] == ["not json"]
    newest = audit.tail(readers.read_log(spark, str(log)), ["ts"], 1).collect()
    assert len(newest) == 1 and newest[0].reason == "r"


def test_retention(spark, tmp_path):
    rows = [("2020-01-01T00:00:00+00:00", True), ("2024-01-01T00:00:00+00:00", True), ("never", True), ("2020-01-01T00:00:00+00:00", False), ("2020-01-01T00:00:00+00:00", None)]
    log = spark.createDataFrame(rows, "ts string, immutable boolean")
    classified = retention.classify(log, F.to_timestamp(F.lit("2024-02-01 00:00:00")), 10)
    assert retention.counts(classified).first().asDict() == {"cleared": 2, "immutable_kept": 2, "immutable_expired": 1, "clearable": 2, "immutable": 3}
    root = str(tmp_path / "log")
    writers.rewrite(log, root, "1")
    writers.rewrite(retention.apply(classified), root, "2")
    assert writers.current(spark, root).count() == 2


def chain(spark, n=25, chains=2):
    rows = [(f"c{c}", f"{i:04d}", f"2024-01-{1 + i:02d}T00:00:00+00:00", json.dumps({"b": i, "a": "é"})) for c in range(chains) for i in range(n)]
    body = evidence.canonical_json(F.from_json("j", "b int, a string, z string"))
    return spark.createDataFrame(rows, "chain_id string, id string, ts string, j string").repartition(3).select("chain_id", "id", "ts", body.alias("body_json"))


def test_seal_is_the_plain_chain(spark):
    import hashlib

    previous, expected = "GENESIS", []
    for i in range(25):
        body = json.dumps({"a": "é", "b": i, "z": None}, sort_keys=True, ensure_ascii=False)
        digest = hashlib.sha256((previous + body).encode()).hexdigest()
        expected.append((i, previous, digest))
        previous = digest
    sealed = evidence.seal(chain(spark)).where("chain_id = 'c1'").orderBy("seq")
    assert [(r.seq, r.prev_hash, r.hash) for r in sealed.collect()] == expected


def test_tampering_is_found(spark, tmp_path):
    sealed = evidence.seal(chain(spark), segment_rows=10)
    root = str(tmp_path / "store")
    writers.write_evidence(sealed, root, "secret")
    index, records = writers.read_evidence(spark, root, "secret")
    assert "body_json" not in index.columns

    def broken(index, records, anchors=None):
        out = evidence.verify(index, records, anchors).where("NOT verified")
        return sorted((r.chain_id, r.seq, r.present, r.hash_ok, r.link_ok) for r in out.collect())

    assert broken(index, records) == []
    edited = records.withColumn("body_json", F.when(F.expr("chain_id = 'c0' AND seq = 3"), F.lit("{}")).otherwise(F.col("body_json")))
    assert broken(index, edited) == [("c0", 3, True, False, True)]
    removed = records.where("NOT (chain_id = 'c1' AND seq = 12)")
    assert broken(index, removed) == [("c1", 12, False, False, False), ("c1", 13, True, True, False)]
    _, wrong = writers.read_evidence(spark, root, "other")
    assert len(broken(index, wrong)) == 50
    # An expired head breaks nothing once verification starts from the anchors.
    kept, anchors = evidence.expire(records, F.to_timestamp(F.lit("2024-01-06")))
    live = index.join(kept.select("chain_id", "seq"), ["chain_id", "seq"], "left_semi")
    assert len(broken(live, kept)) == 2 and broken(live, kept, anchors) == []
    bundle = evidence.handoff(spark.read.parquet(f"{root}/records"), "secret", "fresh")
    assert evidence.open_handoff(bundle, "fresh").where("NOT verified").count() == 0
    assert evidence.open_handoff(bundle, "stale").where("verified").count() == 0
    writers.export(records, evidence.verify(index, records), str(tmp_path / "export"))
    assert spark.read.json(str(tmp_path / "export" / "manifest")).count() == 50
    anchors = jobs.sweep(records, F.to_timestamp(F.lit("2024-04-10")), make_policy({"retention": {"evidence": {"days": 90}}}), str(tmp_path / "swept"), "1")
    assert anchors.count() == 2 and writers.current(spark, str(tmp_path / "swept")).count() == 50 - 2 * (anchors.first().seq + 1)


def test_appends_continue_the_chain(spark, tmp_path):
    rows, root = chain(spark), str(tmp_path / "store")
    for part in ("ts < '2024-01-10'", "ts >= '2024-01-10' AND ts < '2024-01-11'", "ts >= '2024-01-11'"):
        writers.append_evidence(rows.where(part), root, "secret", segment_rows=4)
    index, records = writers.read_evidence(spark, root, "secret")
    stored = writers.read_heads(spark, root)
    assert records.count() == 50 == records.select("chain_id", "seq").distinct().count()
    assert evidence.verify(index, records).where("NOT verified").count() == 0
    assert evidence.verify_heads(stored, records).where("NOT intact").count() == 0
    last = records.agg(F.max("segment")).first()[0]
    for gone in (1, last):  # a whole segment out of index and records, in the middle and at the end
        assert {r.segment for r in evidence.verify_heads(stored, records.where(F.col("segment") != gone)).where("NOT intact").collect()} == {gone}
    kept, anchors = evidence.expire(records, F.to_timestamp(F.lit("2024-01-06")))
    assert evidence.verify_heads(stored, kept, anchors).where("NOT intact").count() == 0
    odd = records.withColumn("ts", F.when(F.col("seq") == 3, "no time").when(F.col("seq") != 4, F.col("ts")))
    kept, _ = evidence.expire(odd, F.to_timestamp(F.lit("2030-01-01")))
    assert sorted({r.seq for r in kept.collect()}) == [3, 4]


def test_versions_and_times(spark, tmp_path):
    for version in ("9", "10", "2"):
        writers.rewrite(spark.range(int(version)), str(tmp_path / "v"), version)
    assert writers.current(spark, str(tmp_path / "v")).count() == 2
    rows = spark.createDataFrame([("2024-01-01T00:00:00", "a"), ("no time", "b"), (None, "c")], "ts string, reason string")
    writers.append_log(rows, str(tmp_path / "log"))
    log = readers.read_log(spark, str(tmp_path / "log"))
    assert {r.reason for r in log.collect()} == {"a", "b", "c"}
    day = log.where("dt = DATE '2024-01-01'")
    assert [r.reason for r in day.collect()] == ["a"] and "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().toString()


def test_heads_chain_the_segments(spark):
    heads = evidence.heads(evidence.seal(chain(spark), segment_rows=10))
    assert evidence.seal(heads).groupBy("chain_id").count().collect()[0]["count"] == 3


def test_reports_and_status(spark, tmp_path):
    results = [{"id": str(i), "phase": "p", "desc": "", "expected": "", "actual": "", "pass": i > 0} for i in range(3)]
    (tmp_path / "run.json").write_text(json.dumps({"label": "x", "ts": "t", "base": "b", "passed": 2, "total": 3, "results": results}, indent=1))
    assert reports.report_summary(readers.read_reports(spark, str(tmp_path / "run.json"))).first() == ("x", "p", 2, 3)
    status = {"ts": "t", "containers": {"a": {"status": "running", "health": ""}, "b": {"status": "running", "health": "bad"}, "c": {"status": "absent"}, "d": {"status": "running"}}}
    (tmp_path / "status.json").write_text(json.dumps(status))
    health = {r.name: r.up for r in reports.service_health(readers.read_status(spark, str(tmp_path / "status.json"))).collect()}
    assert health == {"a": True, "b": False, "d": False}
    folder = tmp_path / "resp"
    folder.mkdir()
    for name, body in {"1": {"ok": True, "errors": [], "completed": "t1", "request": {"targets": ["*"]}}, "2": {"ok": False, "errors": ["a broke"], "completed": "t2", "request": {"targets": ["a"]}}}.items():
        (folder / f"{name}.json").write_text(json.dumps(body))
    (folder / "3.json").write_text("{")
    last = {r.service: r.outcome for r in reports.last_response(readers.read_responses(spark, str(folder)), ["a", "b"], "file").collect()}
    assert last == {"a": "error: a broke", "b": "ok"}
    resident = spark.createDataFrame([(0,), (0,)], "vram long")
    assert reports.gpu_lost(resident).first().alarm and not reports.gpu_lost(resident.limit(0)).first().alarm
    assert [r.warn for r in reports.expiring(spark.createDataFrame([(13.9,), (14.0,), (None,)], "days double")).collect()] == [True, False, False]


def test_redaction_and_leaks(spark):
    rows = spark.createDataFrame([("f", "host a1\nnothing\nHOST again\n" + "host\n" * 9), ("g", "clean")], "file string, text string")
    assert [(r.file, r.line_no) for r in reports.leak_scan(rows, "file", "text", ["host"], shown=5).orderBy("line_no").collect()] == [("f", n) for n in (1, 3, 4, 5, 6)]
    assert rows.where("file = 'f'").select(reports.redact(F.col("text"), [("host", "<h>"), ("", "x"), ("a1", "<n>")], 7)).first()[0] == "<h> <n>"
