"""Streaming queries over the shared tables, run to the end of what is available."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from sluiceway.operators import audit
from sluiceway.plans.conversation import PIECE
from sluiceway.plans.log import ALERT_SQL, VETOES_SQL, vetoes
from sluiceway.plans.registry import query
from sluiceway.plans.series import FAILURE_LIMIT, FAILURE_WINDOW
from sluiceway.plans.texts import _hits_sql, policy
from sluiceway.operators.tripwires import OUTPUT_LISTS, REQUEST_LISTS
from sluiceway.session import cut, epoch_us, load
from sluiceway.streaming import jobs, judged, lockouts, runner, stateful


def _schema(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


_ALERTS_SQL = f"""WITH {VETOES_SQL}
SELECT call_id, '[veto] pre_call ' || reason || ' ' || substr(replace(detail, chr(10), '\\n'), 1, 120) || ' key=' || key_alias || ' model=' || model || ' at ' || substr(ts, 1, 19) AS alert
FROM flags WHERE {ALERT_SQL}"""


@query("stream_alerts", _ALERTS_SQL)
def stream_alerts(spark, sf):
    log = audit.records(vetoes(runner.follow_table(spark, sf, "events")), policy())
    return runner.run(spark, lambda out, ckpt: runner.to_table(jobs.alert_stream(log), out, ckpt), _schema("call_id STRING, alert STRING"))


@query("stream_alerts_once", _ALERTS_SQL)
def stream_alerts_once(spark, sf):
    """Every file is delivered twice; the alerts are those of one delivery."""
    twice = runner.follow_table(spark, sf, "events").unionByName(runner.follow_table(spark, sf, "events"))
    log = audit.records(vetoes(twice), policy())
    return runner.run(spark, lambda out, ckpt: runner.to_table(jobs.alerts_once(log), out, ckpt), _schema("call_id STRING, alert STRING"))


@query("stream_scan", f"WITH {_hits_sql(REQUEST_LISTS)} SELECT CAST(doc_id AS VARCHAR) AS call_id, 'regex:' || list AS reason, pattern, span FROM hits")
def stream_scan(spark, sf):
    texts = runner.follow_table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("call_id"), "text")
    watch = runner.PolicyWatch(spark, policy=policy())
    return runner.run(spark, lambda out, ckpt: jobs.scan_stream(texts, watch, out, ckpt), _schema(jobs.SCAN_SCHEMA))


@query("stream_lockouts", f"""
WITH RECURSIVE a AS (SELECT CAST(user_id AS VARCHAR) AS account, epoch_us(ts) AS ts_us, event_type = 'error' AS failed,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type = 'error' DESC) AS n FROM events WHERE event_type IN ('error', 'signup')),
w AS (SELECT account, 0::BIGINT AS n, 0::BIGINT AS ts_us, '' AS outcome, []::BIGINT[] AS held FROM (SELECT DISTINCT account FROM a)
  UNION ALL SELECT account, n, ts_us,
    CASE WHEN len(recent) >= {FAILURE_LIMIT} THEN 'refused' WHEN failed THEN 'failed' ELSE 'ok' END,
    CASE WHEN len(recent) >= {FAILURE_LIMIT} THEN recent WHEN failed THEN list_append(recent, ts_us) ELSE [] END
  FROM (SELECT a.account, a.n, a.ts_us, a.failed, list_filter(w.held, lambda t: a.ts_us - t < {FAILURE_WINDOW * 1_000_000}) AS recent
    FROM w JOIN a ON a.account = w.account AND a.n = w.n + 1))
SELECT account, ts_us, outcome FROM w WHERE n > 0""")
def stream_lockouts(spark, sf):
    rows = runner.follow_table(spark, sf, "events").where("event_type IN ('error', 'signup')")
    attempts = rows.select(
        F.col("user_id").cast("string").alias("account"), epoch_us(F.col("ts")).alias("ts_us"), (F.col("event_type") == "error").alias("failed"),
    )
    ended = []

    def start(out: str, checkpoint: str):
        job = lockouts.LockoutJob(spark, f"{checkpoint}-work", out, FAILURE_LIMIT, FAILURE_WINDOW, FAILURE_WINDOW * 1_000_000)
        ended.append(job.close)
        return runner.each_batch(attempts, job.handle, checkpoint)

    return runner.run(spark, start, _schema(lockouts.ATTEMPTS), finish=lambda: ended[0]())


GATE_START = 1_700_000_000
GATE_END = 2**62  # microseconds, later than any turn
_GATE_HITS = _hits_sql(OUTPUT_LISTS, "(SELECT conv_id * 100 + turn AS msg, text FROM conversations WHERE role = 'assistant')", "msg")


def turn_id(conversation: str, turn: str):
    """A call for each turn. The number of a turn would not do: turn 100 of a conversation has that of turn 0 of the next one."""
    return F.concat(F.col(conversation).cast("string"), F.lit(":"), F.col(turn).cast("string"))


def turn_number(call_id: str):
    conversation, turn = (F.split_part(F.col(call_id), F.lit(":"), F.lit(k)).cast("long") for k in (1, 2))
    return (conversation * 100 + turn).cast("string")


def turn_chunks(spark, sf):
    """Assistant turns as a stream of chunks; a turn's chunks come in the minute that its number names."""
    turns = runner.follow_table(spark, sf, "conversations").where("role = 'assistant'")
    at = F.posexplode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))).alias("seq", "start")
    number = F.col("conv_id") * 100 + F.col("turn")
    pieces = turns.select(turn_id("conv_id", "turn").alias("call_id"), number.alias("number"), "text", at)
    nothing = F.lit(None).cast("string")
    return pieces.select(
        "call_id", F.col("seq").cast("long").alias("seq"), F.lit(0).alias("choice"),
        F.substring("text", F.col("start"), F.lit(PIECE)).alias("content"), nothing.alias("reasoning"), F.lit(None).cast("int").alias("tool_idx"),
        nothing.alias("tool_name"), nothing.alias("tool_args"), (F.col("start") + PIECE > F.length("text")).alias("finished"), F.lit(1).alias("choices"),
        F.timestamp_seconds(F.lit(GATE_START) + F.col("number") * 60).alias("at"),
    )


@query("stream_gate", f"""WITH {_GATE_HITS},
a AS (SELECT conv_id * 100 + turn AS msg, text FROM conversations WHERE role = 'assistant')
SELECT CAST(a.msg AS VARCHAR) AS call_id, CASE WHEN list IS NULL THEN 'stop' ELSE 'content_filter' END AS finish_reason,
  coalesce('regex:' || list, '') AS reason, sha256(CASE WHEN list IS NULL THEN text ELSE '{stateful.WITHHELD_TEXT}' END) AS digest FROM a LEFT JOIN hits USING (msg)""")
def stream_gate(spark, sf):
    """Assistant turns streamed in pieces, held, checked, and released or withheld."""
    chunks = turn_chunks(spark, sf)

    def start(out: str, checkpoint: str):
        def handle(batch, batch_id):
            # The release reads the calls twice; the stateful step must run once.
            runner.write_batch(stateful.release(cut(batch).withColumn("call_id", turn_number("call_id")), policy()), out, batch_id)

        return runner.each_batch(stateful.buffer_calls(chunks, hold_ms=None), handle, checkpoint)

    rows = runner.run(spark, start, _schema(stateful.RELEASED))
    return rows.select("call_id", "finish_reason", F.coalesce("reason", F.lit("")).alias("reason"), F.sha2("text", 256).alias("digest"))


@query("stream_gate_judged", f"""WITH {_GATE_HITS},
a AS (SELECT conv_id, conv_id * 100 + turn AS msg, text FROM conversations WHERE role = 'assistant'),
v AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN 'unread' WHEN toxic = 1 THEN 'blocked' ELSE 'passed' END AS verdict FROM labels WHERE doc_id % 13 <= 10),
j AS (SELECT a.msg, a.text, CASE WHEN list IS NOT NULL THEN 'regex:' || list WHEN verdict = 'blocked' THEN 'classifier'
    WHEN verdict = 'unread' THEN 'guard_verdict_unparseable' WHEN verdict IS NULL THEN 'guard_unavailable' ELSE '' END AS reason
  FROM a LEFT JOIN hits USING (msg) LEFT JOIN v ON v.doc_id = a.conv_id)
SELECT CAST(msg AS VARCHAR) AS call_id, CASE WHEN reason = '' THEN 'stop' ELSE 'content_filter' END AS finish_reason, reason,
  sha256(CASE WHEN reason = '' THEN text ELSE '{stateful.WITHHELD_TEXT}' END) AS digest FROM j""")
def stream_gate_judged(spark, sf):
    """As ``stream_gate``, and nothing goes out without the classifier's verdict. A label stands for the answers on the turns of the conversation with
    its number; they come after 0 to 12 minutes, those after more than 10 too late."""
    root = runner.new_root(spark)
    runner.to_table(stateful.buffer_calls(turn_chunks(spark, sf), hold_ms=None), f"{root}/held", f"{root}/held-checkpoint").awaitTermination()
    # Both feeds end with a row of a far time, so that the watermark passes everything before it.
    end = F.timestamp_micros(F.lit(GATE_END))
    # (They need an id and a part: a row without them cannot be joined and is dropped before its time is seen. No answer has nulls: the join's
    # state is read by the types of the batch at hand, and in a batch without files Spark takes the answers' constants for never null.)
    spark.range(1).select(*[(end if f.name == "ended_at" else F.lit("" if f.name == "call_id" else None)).cast(f.dataType).alias(f.name) for f in _schema(stateful.BUFFERED)]).write.parquet(f"{root}/end-held")
    spark.range(1).select(end.alias("judged_at")).write.parquet(f"{root}/end")

    # Answers come on the turns that there are, however many: the join's state holds no others.
    turns = load(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn")
    labels = runner.follow_table(spark, sf, "labels").select("doc_id", "toxic").join(turns, F.col("doc_id") == F.col("conv_id"))
    number = F.col("conv_id") * 100 + F.col("turn")
    raw = F.when(F.col("doc_id") % 17 == 0, "hm").when(F.col("toxic") == 1, "unsafe\nS1").otherwise("safe")
    answers = labels.select(turn_id("conv_id", "turn").alias("call_id"), F.lit(0).alias("part_idx"), F.lit("llama-guard").alias("model"), raw.alias("raw"),
                            F.timestamp_seconds(F.lit(GATE_START) + (number + F.col("doc_id") % 13) * 60).alias("judged_at"))
    ended = spark.readStream.schema("judged_at TIMESTAMP").parquet(f"{root}/end").select(
        F.lit("").alias("call_id"), F.lit(0).alias("part_idx"), *[F.lit("").alias(n) for n in ("model", "raw")], "judged_at")
    held, held_end = (spark.readStream.schema(stateful.BUFFERED).parquet(f"{root}/{folder}") for folder in ("held", "end-held"))

    def start(out: str, checkpoint: str):
        def handle(batch, batch_id):
            calls = cut(batch.where("call_id <> ''")).withColumn("call_id", turn_number("call_id"))
            runner.write_batch(stateful.release(calls, policy()), out, batch_id)

        return runner.each_batch(judged.judge(held.unionByName(held_end), answers.unionByName(ended), policy()), handle, checkpoint)

    rows = runner.run(spark, start, _schema(stateful.RELEASED))
    return rows.select("call_id", "finish_reason", F.coalesce("reason", F.lit("")).alias("reason"), F.sha2("text", 256).alias("digest"))
