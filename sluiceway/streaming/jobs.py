"""Stateless streams: alerts, safety scan, retention sweep. They reuse the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluiceway.functions.columns import bind
from sluiceway.functions.text import normalise
from sluiceway.operators import audit, evidence, retention, tripwires
from sluiceway.policy import Policy
from sluiceway.session import cut
from sluiceway.sources.writers import rewrite
from sluiceway.streaming.runner import PolicyWatch, each_batch, write_batch

SCAN_SCHEMA = "call_id STRING, reason STRING, pattern STRING, span STRING"


def alert_stream(log: DataFrame) -> DataFrame:
    """Alert texts of an audit log followed as a stream."""
    return audit.alerts(log)


def alerts_once(log: DataFrame, late: str = "7 days") -> DataFrame:
    """Alert texts of a log whose files may come more than once: one alert for each call, stage and reason.

    Spark keeps the keys of alert-worthy records alone, and drops each after ``late`` past its time; ``late`` is also how far
    behind the newest record one may come and still alert. A record without a readable time always alerts.
    """
    timed = log.where(audit.is_alert(F.col("reason"), F.col("detail"))).withColumn("_at", F.col("ts").try_cast("timestamp"))
    once = timed.where("_at IS NOT NULL").withWatermark("_at", late).dropDuplicatesWithinWatermark(["call_id", "stage", "reason"])
    return audit.alerts(once.drop("_at").unionByName(timed.where("_at IS NULL").drop("_at")))


def scan_texts(texts: DataFrame, policy: Policy, lists: tuple[str, ...] = tripwires.REQUEST_LISTS) -> DataFrame:
    """Veto rows of ``(call_id, text)``."""
    if not policy.document["tripwires"]["enabled"]:
        return texts.where(F.lit(False)).select("call_id", *[F.lit("").alias(c) for c in ("reason", "pattern", "span")])
    norm = bind(texts, "norm", normalise(F.col("text")))
    hits = tripwires.scan(norm, "norm", lists, policy.extra_patterns)
    return hits.select("call_id", F.concat(F.lit("regex:"), "hit.list").alias("reason"), F.col("hit.pattern").alias("pattern"), "span")


def scan_stream(texts: DataFrame, watch: PolicyWatch, path: str, checkpoint: str) -> StreamingQuery:
    """Scan a stream of texts under the policy in force at each micro-batch."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(scan_texts(batch, watch.current()), path, batch_id)

    return each_batch(texts, handle, checkpoint)


def sweep(records: DataFrame, as_of: Column, policy: Policy, root: str, version: str) -> DataFrame:
    """One retention sweep over the evidence store: writes the kept records as a new version and
    returns the anchors of the shortened chains. Schedule it every six hours or so."""
    limit = retention.cutoff(as_of, policy.retention["evidence"]["days"])
    kept, anchors = evidence.expire(records, limit)
    anchors = cut(anchors)
    rewrite(kept, root, version)
    return anchors


def notify(alerts: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of alerts to a sink of the user's choice."""
    return each_batch(alerts, send, checkpoint)
