"""Queries over the audit log, retention and evidence, with events standing in for vetoes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import audit, evidence, reports, retention
from sluiceway.plans.registry import query
from sluiceway.plans.texts import GUARD, NAMES_SQL, policy
from sluiceway.policy import category_names
from sluiceway.session import cut, iso_text, load

AS_OF = "2024-04-15 00:00:00"
IMMUTABLE_DAYS = 90
EVIDENCE_DAYS = 90
SEGMENT_ROWS = 8


def vetoes(events: DataFrame) -> DataFrame:
    """Error events as vetoes; ``event_id`` picks the kind of refusal."""
    kind = F.col("event_id") % 6
    code = F.concat(F.lit("S"), (F.floor("value") % 14 + 1).cast("string"))
    reason = F.when(kind == 0, "regex:csam").when(kind == 1, "regex:extra").when(kind == 2, "guard_unavailable").when(
        kind == 3, "regex:sentinel").otherwise("classifier")
    detail = F.when(reason == "classifier", category_names(F.array(code))).otherwise(F.concat(F.lit("pattern\n"), F.repeat("props", 20)))
    return events.where("event_type = 'error'").select(
        iso_text(F.col("ts")).alias("ts"), F.lit("pre_call").alias("stage"), reason.alias("reason"), detail.alias("detail"),
        F.col("event_id").cast("string").alias("call_id"), F.lit(GUARD).alias("model"), F.col("user_id").cast("string").alias("key_alias"),
        F.lit(None).cast("string").alias("device_fingerprint"), "event_id", "value",
    )


def veto_log(spark: SparkSession, sf: str) -> DataFrame:
    return vetoes(load(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props"))


VETOES_SQL = f"""
{NAMES_SQL},
vetoes AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+00:00') AS ts, ts AS moment, 'pre_call' AS stage, reason,
    CASE WHEN reason = 'classifier' THEN code || ' ' || name ELSE 'pattern' || chr(10) || repeat(props, 20) END AS detail,
    CAST(event_id AS VARCHAR) AS call_id, '{GUARD}' AS model, CAST(user_id AS VARCHAR) AS key_alias, event_id, value, code
  FROM (SELECT *, CASE event_id % 6 WHEN 0 THEN 'regex:csam' WHEN 1 THEN 'regex:extra' WHEN 2 THEN 'guard_unavailable' WHEN 3 THEN 'regex:sentinel' ELSE 'classifier' END AS reason,
      'S' || CAST(1 + CAST(floor(value) AS BIGINT) % 14 AS VARCHAR) AS c FROM events WHERE event_type = 'error') e JOIN names ON names.code = e.c),
flags AS (SELECT *, reason = 'regex:csam' OR (reason = 'classifier' AND code IN ('S3', 'S4', 'S10', 'S11')) AS immutable,
    reason = 'regex:csam' OR (reason = 'classifier' AND code = 'S4') AS evidence FROM vetoes)
"""


@query("audit_flags", f"""WITH {VETOES_SQL}
SELECT call_id, CASE WHEN reason = 'classifier' THEN code ELSE '' END AS codes, immutable, evidence FROM flags""")
def audit_flags(spark, sf):
    rows, rules = veto_log(spark, sf), policy()
    reason, detail = F.col("reason"), F.col("detail")
    return rows.select(
        "call_id", F.array_join(audit.category_codes(detail), ",").alias("codes"),
        audit.is_immutable(reason, detail, rules).alias("immutable"), audit.wants_evidence(reason, detail, rules).alias("evidence"),
    )


@query("audit_records", f"""WITH {VETOES_SQL}
SELECT ts, stage, reason, replace(detail, chr(10), '\\n') AS detail, call_id, model, key_alias, CAST(NULL AS VARCHAR) AS device_fingerprint, immutable, CASE WHEN evidence THEN call_id END AS evidence_id FROM flags""")
def audit_records(spark, sf):
    return audit.records(veto_log(spark, sf), policy())


ALERT_SQL = """
((reason = 'classifier' AND code IN ('S1', 'S2', 'S3', 'S4', 'S9', 'S10', 'S11')) OR reason IN ('regex:csam', 'regex:extra', 'guard_unavailable'))
"""


@query("alerts", f"""WITH {VETOES_SQL}
SELECT call_id, '[veto] pre_call ' || reason || ' ' || substr(replace(detail, chr(10), '\\n'), 1, 120) || ' key=' || key_alias || ' model=' || model || ' at ' || substr(ts, 1, 19) AS alert
FROM flags WHERE {ALERT_SQL}""")
def alerts(spark, sf):
    return audit.alerts(audit.records(veto_log(spark, sf), policy()))


@query("flagged_snippets", f"""WITH {VETOES_SQL}
SELECT ts, stage, reason, substr(detail, 1, 60) AS detail, call_id, key_alias, substr(trim(text), 1, 160) AS snippet
FROM flags JOIN documents ON doc_id = event_id WHERE NOT (contains(detail, 'S4') OR contains(detail, 'csam') OR contains(detail, 'despaced') OR contains(reason, 'csam'))""")
def flagged_snippets(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("event_id"), "text")
    return audit.snippets(veto_log(spark, sf).join(docs, "event_id"), policy())


@query("audit_tail", f"""WITH {VETOES_SQL} SELECT ts, call_id, reason FROM flags ORDER BY moment DESC, event_id DESC LIMIT 200""")
def audit_tail(spark, sf):
    return audit.tail(veto_log(spark, sf), ["ts", "event_id"], 200).select("ts", "call_id", "reason")


@query("audit_page", f"""WITH {VETOES_SQL}, n AS (SELECT count(*) AS total FROM flags)
SELECT ts, call_id, 3 AS page, CAST(ceil(total / 50.0) AS INTEGER) AS pages, total FROM flags, n ORDER BY moment DESC, event_id DESC LIMIT 50 OFFSET 100""")
def audit_page(spark, sf):
    order = [F.col("ts").desc(), F.col("event_id").desc()]
    rows = audit.page(veto_log(spark, sf).select("ts", "call_id", "event_id"), order, per=50, number=3)
    return rows.select("ts", "call_id", "page", "pages", F.col("total").cast("long").alias("total"))


@query("audit_union", f"""WITH {VETOES_SQL}
SELECT call_id, stage, reason, CAST(NULL AS VARCHAR) AS client_ip, CAST(NULL AS VARCHAR) AS action FROM vetoes
UNION ALL SELECT 'page-' || page_id, 'image_output', 'classifier', '10.0.0.' || (page_id % 256), 'destroy_nsfw' FROM pages""")
def audit_union(spark, sf):
    images = load(spark, sf, "pages").select(
        F.concat(F.lit("page-"), "page_id").alias("call_id"), F.lit("image_output").alias("stage"), F.lit("classifier").alias("reason"),
        F.concat(F.lit("10.0.0."), F.col("page_id") % 256).alias("client_ip"), F.lit("destroy_nsfw").alias("action"),
    )
    return audit.union_logs(veto_log(spark, sf).select("call_id", "stage", "reason"), images)


# ---- retention -------------------------------------------------------------------------------

def _classified(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.records(veto_log(spark, sf), policy())
    return retention.classify(rows, F.to_timestamp(F.lit(AS_OF)), IMMUTABLE_DAYS)


OUTCOME_SQL = f"""{VETOES_SQL},
o AS (SELECT *, CASE WHEN NOT immutable THEN 'cleared' WHEN moment < TIMESTAMP '{AS_OF}' - INTERVAL {IMMUTABLE_DAYS} DAY THEN 'immutable_expired' ELSE 'immutable_kept' END AS outcome FROM flags)
"""


@query("retention_apply", f"WITH {OUTCOME_SQL} SELECT call_id, ts, reason, outcome FROM o")
def retention_apply(spark, sf):
    return _classified(spark, sf).select("call_id", "ts", "reason", "outcome")


@query("retention_counts", f"""WITH {OUTCOME_SQL}
SELECT count(*) FILTER (outcome = 'cleared') AS cleared, count(*) FILTER (outcome = 'immutable_kept') AS immutable_kept,
  count(*) FILTER (outcome = 'immutable_expired') AS immutable_expired, count(*) FILTER (NOT immutable) AS clearable, count(*) FILTER (immutable) AS immutable FROM o""")
def retention_counts(spark, sf):
    return retention.counts(_classified(spark, sf))


# ---- evidence --------------------------------------------------------------------------------

def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence bodies of the vetoes that call for one; a chain per day."""
    rows, rules = veto_log(spark, sf), policy()
    wanted = rows.where(audit.wants_evidence(F.col("reason"), F.col("detail"), rules))
    nothing = F.lit(None).cast("string")
    record = F.struct(
        F.col("call_id").alias("id"), "ts", "stage", "reason", "detail", evidence.categories_of(F.col("detail")).alias("categories"),
        "call_id", "model", "key_alias", nothing.alias("client_ip"), nothing.alias("user_agent"), "device_fingerprint",
        nothing.alias("device_subject"), nothing.alias("output"),
    )
    return wanted.select(F.substring("ts", 1, 10).alias("chain_id"), F.lpad("call_id", 12, "0").alias("id"), "ts", evidence.canonical_json(record).alias("body_json"))


def sealed(spark: SparkSession, sf: str) -> DataFrame:
    return evidence.seal(bodies(spark, sf), SEGMENT_ROWS)


SEAL_SQL = f"""
WITH RECURSIVE {VETOES_SQL},
b AS (SELECT substr(ts, 1, 10) AS chain_id, lpad(call_id, 12, '0') AS id, ts, moment, value,
  '{{"call_id": "' || call_id || '", "categories": ' || CASE WHEN reason = 'classifier' THEN '[{{"code": "S4", "name": "Child Sexual Exploitation"}}]' ELSE '[]' END
  || ', "client_ip": null, "detail": "' || replace(replace(replace(detail, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n') || '", "device_fingerprint": null, "device_subject": null, "id": "' || call_id
  || '", "key_alias": "' || key_alias || '", "model": "' || model || '", "output": null, "reason": "' || reason || '", "stage": "' || stage || '", "ts": "' || ts || '", "user_agent": null}}' AS body
  FROM flags WHERE evidence),
n AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts, id) - 1 AS seq FROM b),
s AS (
  SELECT chain_id, seq, id, ts, moment, value, body, 'GENESIS' AS prev_hash, sha256('GENESIS' || body) AS hash FROM n WHERE seq = 0
  UNION ALL
  SELECT n.chain_id, n.seq, n.id, n.ts, n.moment, n.value, n.body, CASE WHEN n.seq % {SEGMENT_ROWS} = 0 THEN 'GENESIS' ELSE s.hash END,
    sha256(CASE WHEN n.seq % {SEGMENT_ROWS} = 0 THEN 'GENESIS' ELSE s.hash END || n.body)
  FROM s JOIN n ON n.chain_id = s.chain_id AND n.seq = s.seq + 1)
"""


@query("evidence_seal", f"{SEAL_SQL} SELECT chain_id, CAST(seq // {SEGMENT_ROWS} AS BIGINT) AS segment, seq, id, ts, prev_hash, hash FROM s")
def evidence_seal(spark, sf):
    return sealed(spark, sf).select("chain_id", "segment", "seq", "id", "ts", "prev_hash", "hash")


@query("evidence_heads", f"""{SEAL_SQL}, h AS (SELECT chain_id, seq // {SEGMENT_ROWS} AS segment, arg_max(hash, seq) AS head, count(*) AS rows, max(seq) AS last FROM s GROUP BY ALL)
SELECT chain_id, lpad(CAST(segment AS VARCHAR), 12, '0') AS id, '{{"chain_id": "' || chain_id || '", "head": "' || head || '", "last": ' || last || ', "rows": ' || rows || ', "segment": ' || segment || '}}' AS body_json FROM h""")
def evidence_heads(spark, sf):
    return evidence.heads(sealed(spark, sf)).select("chain_id", "id", "body_json")


def _tampered(records: DataFrame) -> DataFrame:
    """Every record about key 77 was edited and every one about key 7 was removed."""
    edited = F.regexp_replace("body_json", '"key_alias": "77"', '"key_alias": "78"')
    return records.withColumn("body_json", edited).where(~F.contains("body_json", F.lit('"key_alias": "7"')))


TAMPER_SQL = f"""{SEAL_SQL},
t AS (SELECT *, contains(body, '"key_alias": "77"') AS edited, contains(body, '"key_alias": "7"') AS removed FROM s),
v AS (SELECT t.chain_id, t.seq, t.id, NOT t.removed AS present, NOT t.removed AND NOT t.edited AS hash_ok,
   NOT t.removed AND (t.seq % {SEGMENT_ROWS} = 0 OR NOT coalesce(p.removed, true)) AS link_ok
   FROM t LEFT JOIN t p ON p.chain_id = t.chain_id AND p.seq = t.seq - 1)
"""


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    records = cut(sealed(spark, sf))  # stands for the stored table: read three times, sealed once
    return evidence.verify(evidence.index_of(records), _tampered(records))


@query("evidence_verify", f"{TAMPER_SQL} SELECT chain_id, seq, id, present, hash_ok, link_ok, hash_ok AND link_ok AS verified FROM v")
def evidence_verify(spark, sf):
    return _verified(spark, sf)


@query("evidence_summary", f"""{TAMPER_SQL} SELECT chain_id, bool_and(hash_ok AND link_ok) AS intact, count(*) AS records,
  count(*) FILTER (hash_ok AND link_ok) AS verified, count(*) FILTER (NOT present) AS missing FROM v GROUP BY chain_id""")
def evidence_summary(spark, sf):
    return evidence.summary(_verified(spark, sf))


@query("evidence_expire", f"""{SEAL_SQL}, c AS (SELECT *, moment < TIMESTAMP '{AS_OF}' - INTERVAL {EVIDENCE_DAYS} DAY AS old FROM s)
SELECT 'kept' AS part, chain_id, seq, hash FROM c WHERE NOT old
UNION ALL SELECT 'anchor', chain_id, max(seq), arg_max(hash, seq) FROM c WHERE old GROUP BY chain_id""")
def evidence_expire(spark, sf):
    cutoff = retention.cutoff(F.to_timestamp(F.lit(AS_OF)), EVIDENCE_DAYS)
    kept, anchors = evidence.expire(cut(sealed(spark, sf)), cutoff)
    return kept.select(F.lit("kept").alias("part"), "chain_id", "seq", "hash").unionByName(
        anchors.select(F.lit("anchor").alias("part"), "chain_id", "seq", "hash")
    )


@query("evidence_append", f"""{SEAL_SQL.replace("n AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts, id) - 1 AS seq FROM b)", """
n AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY late, ts, id) - 1 AS seq, row_number() OVER (PARTITION BY chain_id, late ORDER BY ts, id) - 1 AS place
  FROM (SELECT *, substr(ts, 12, 2) >= '12' AS late FROM b))""").replace(f"n.seq % {SEGMENT_ROWS} = 0", f"n.place % {SEGMENT_ROWS} = 0")} SELECT chain_id, seq, id, prev_hash, hash FROM s""")
def evidence_append(spark, sf):
    """Two batches: the mornings, then the afternoons, each continuing the stored chain of its day."""
    rows = bodies(spark, sf)
    late = F.substring("ts", 12, 2) >= "12"
    first = cut(evidence.seal(rows.where(~late), SEGMENT_ROWS))
    second = evidence.seal(rows.where(late), SEGMENT_ROWS, evidence.tails(first))
    return first.unionByName(second).select("chain_id", "seq", "id", "prev_hash", "hash")


@query("evidence_segment_removed", f"""{SEAL_SQL}, h AS (SELECT chain_id, CAST(seq // {SEGMENT_ROWS} AS BIGINT) AS segment, count(*) AS rows FROM s GROUP BY ALL)
SELECT chain_id, segment, rows, CASE WHEN segment = 1 THEN 0 ELSE rows END AS found, segment <> 1 AS intact FROM h""")
def evidence_segment_removed(spark, sf):
    """The second segment of every chain was taken out of index and records; the heads still tell."""
    records = cut(sealed(spark, sf))
    stored = evidence.seal(evidence.heads(records), None)
    return evidence.verify_heads(stored, records.where("segment <> 1"))


@query("evidence_manifest", f"{SEAL_SQL} SELECT id || '.json' AS file, sha256(body) AS sha256 FROM s")
def evidence_manifest(spark, sf):
    return evidence.manifest(sealed(spark, sf))


# ---- reports over events ---------------------------------------------------------------------

@query("last_use", "SELECT coalesce(max(epoch_us(ts)), 0) AS last_use FROM events")
def last_use(spark, sf):
    return reports.last_use(load(spark, sf, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("at")), "at")


@query("latest_per_key", """
SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_per_key(spark, sf):
    rows = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return reports.latest_per_key(rows, "user_id", ["ts", "event_id"], ["event_id", "event_type", "value"])


@query("report_summary", """
SELECT CAST(date_trunc('day', ts) AS DATE)::VARCHAR AS label, event_type AS phase, count(*) FILTER (value >= 50) AS passed, count(*) AS total FROM events GROUP BY ALL""")
def report_summary(spark, sf):
    results = load(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("label"), F.col("event_type").alias("phase"), (F.col("value") >= 50).alias("pass"))
    return reports.report_summary(results)


SERVICES = ["gateway", "console", "engine", "proxy", "images"]


@query("service_last_response", """
WITH s(service, n) AS (VALUES ('gateway', 0), ('console', 1), ('engine', 2), ('proxy', 3), ('images', 4)),
r AS (SELECT service, ts, event_id, event_type <> 'error' AS ok FROM events JOIN s ON n = user_id % 6 OR user_id % 6 = 5)
SELECT service, CASE WHEN ok THEN 'ok' ELSE 'error: ' || service || ' failed' END AS outcome, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS completed
FROM r QUALIFY row_number() OVER (PARTITION BY service ORDER BY ts DESC, event_id DESC) = 1""")
def service_last_response(spark, sf):
    """Events as operation responses: the user picks the target, one in six is for every service."""
    target = F.try_element_at(F.array(*[F.lit(s) for s in SERVICES]), (F.col("user_id") % 6 + 1).cast("int"))
    responses = load(spark, sf, "events").select(
        F.array(F.coalesce(target, F.lit("*"))).alias("targets"), (F.col("event_type") != "error").alias("ok"),
        F.transform(F.array(*[F.lit(s) for s in SERVICES]), lambda s: F.concat(s, F.lit(" failed"))).alias("errors"),
        iso_text(F.col("ts")).alias("completed"), F.struct("ts", "event_id").alias("at"),
    )
    return reports.last_response(responses, SERVICES, "at")
