"""Acceptance reports, service status, redaction, leak scans, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions.columns import bind

# Fixed values.
ACTUAL_CHARS = 300
MIN_DAYS_LEFT = 14
EVERY_SERVICE = "*"


def report_summary(results: DataFrame) -> DataFrame:
    """Passed and total assertions per run and phase."""
    return results.groupBy("label", "phase").agg(F.count_if(F.col("pass")).alias("passed"), F.count(F.lit(1)).alias("total"))


def redact(text: Column, private: list[tuple[str, str]], limit: int | None = None) -> Column:
    """Known private values replaced by placeholders, in order; empty values are skipped.

    The list is an operator's handful of values, folded into one expression.
    """
    for value, placeholder in private:
        if value:
            text = F.replace(text, F.lit(value), F.lit(placeholder))
    return F.substring(text, 1, limit) if limit else text


def redact_patterns(text: Column, private: list[tuple[str, str]]) -> Column:
    for pattern, placeholder in private:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def leak_scan(files: DataFrame, key: str, text: str, patterns: list[str], shown: int | None = None) -> DataFrame:
    """Lines of each file that hold a private pattern, with line numbers. Files without a hit are dropped before their lines are
    exploded. A report may show the first ``shown`` lines of a file only; these are limited before the shuffle."""
    any_pattern = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    tested = bind(files.select(key, text), "_leaks", F.col(text).rlike(any_pattern))
    lines = tested.where("_leaks").select(key, F.posexplode(F.split(text, "\n")).alias("at", "line"))
    hits = lines.where(F.col("line").rlike(any_pattern)).select(key, (F.col("at") + 1).alias("line_no"), "line")
    if shown is None:
        return hits
    first = Window.partitionBy(key).orderBy("line_no")
    return hits.withColumn("n", F.row_number().over(first)).where(F.col("n") <= shown).drop("n")


def is_healthy(status: Column, health: Column) -> Column:
    return (status == "running") & F.coalesce(health.isin("", "healthy"), F.lit(False))


def service_health(containers: DataFrame) -> DataFrame:
    """(name, up) of services that exist."""
    return containers.where(F.col("status") != "absent").select("name", is_healthy(F.col("status"), F.col("health")).alias("up"))


def response_targets(responses: DataFrame, services: list[str]) -> DataFrame:
    """Responses per target; ``*`` stands for every service (an installation's short list)."""
    everyone = F.array(*[F.lit(s) for s in services])
    fanned = F.array_distinct(F.flatten(F.transform("targets", lambda t: F.when(t == EVERY_SERVICE, everyone).otherwise(F.array(t)))))
    return responses.withColumn("service", F.explode(fanned))


def last_response(responses: DataFrame, services: list[str], order: str) -> DataFrame:
    """Latest response per service."""
    targets = response_targets(responses, services)
    newest = F.max_by(F.struct("ok", "errors", "completed"), order)
    picked = targets.groupBy("service").agg(newest.alias("r"))
    errors = F.filter("r.errors", lambda e: F.contains(e, F.col("service")))
    outcome = F.when(F.col("r.ok"), "ok").when(
        F.size(errors) > 0, F.concat(F.lit("error: "), F.substring(F.array_join(errors, "; "), 1, 80))
    ).otherwise("error (see responses)")
    return picked.select("service", outcome.alias("outcome"), F.substring("r.completed", 1, 19).alias("completed"))


def gpu_lost(resident: DataFrame) -> DataFrame:
    """Alarm when something is resident and none of it holds device memory."""
    return resident.agg(((F.count(F.lit(1)) > 0) & F.coalesce(F.bool_and(F.col("vram") == 0), F.lit(False))).alias("alarm"))


def expiring(certificates: DataFrame) -> DataFrame:
    return certificates.withColumn("warn", F.coalesce("days", F.lit(99)) < MIN_DAYS_LEFT)


def last_use(uses: DataFrame, ts: str) -> DataFrame:
    """Latest use over everything; 0 when there was none."""
    return uses.agg(F.coalesce(F.max(ts), F.lit(0)).alias("last_use"))


def latest_per_key(rows: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """Newest row per key, combined map-side."""
    newest = F.max(F.struct(*order, *[c for c in payload if c not in order]))
    return rows.groupBy(key).agg(newest.alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in payload])


def items_per_user(items: DataFrame, user: str) -> DataFrame:
    return items.groupBy(user).agg(F.count(F.lit(1)).alias("items"))


def newest_first(items: DataFrame, user: str, order: list[str], shown: int) -> DataFrame:
    """A page of each user's newest items, ranked from 1; ties by the later columns of ``order``."""
    latest = Window.partitionBy(user).orderBy(*[F.col(c).desc() for c in order])
    return items.withColumn("rank", F.row_number().over(latest)).where(F.col("rank") <= shown)


def own_rows(rows: DataFrame, mine: DataFrame, key: str) -> DataFrame:
    """History restricted to the user's own ids."""
    return rows.join(mine.select(key).distinct(), key, "left_semi")
