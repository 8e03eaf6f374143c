"""Queries over metric samples and login attempts, with events standing in for both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import lockout, metrics, ordering
from sluiceway.plans.registry import query
from sluiceway.session import epoch_us, load

DAY = 86_400
END_US = 1_706_659_200_000_000  # 2024-01-31 00:00 UTC, the end of the fixture
GRID_MINUTES, GRID_STEP = 30 * 1440, 6 * 3600
RATE_WINDOW = 2 * DAY
FAILURE_LIMIT, FAILURE_WINDOW = 3, 3 * DAY


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events as samples of one series per user; values in exact cents."""
    return load(spark, sf, "events").select(
        F.col("user_id").alias("series"), epoch_us(F.col("ts")).alias("ts_us"), F.col("event_type").alias("metric"), "value",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def counters(spark: SparkSession, sf: str) -> DataFrame:
    """Running total of cents per user."""
    return ordering.running_sum(samples(spark, sf), "series", "ts_us", "cents", "value", DAY * 1_000_000).select("series", "ts_us", "value")


SAMPLES_SQL = "s AS (SELECT user_id AS series, epoch_us(ts) AS ts_us, event_type AS metric, value, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
COUNTERS_SQL = f"{SAMPLES_SQL}, c AS (SELECT series, ts_us, CAST(sum(cents) OVER (PARTITION BY series ORDER BY ts_us) AS BIGINT) AS value FROM s)"


@query("metric_latest", f"WITH {SAMPLES_SQL} SELECT series, max(ts_us) AS ts_us, arg_max(value, ts_us) AS value FROM s GROUP BY series")
def metric_latest(spark, sf):
    return metrics.latest(samples(spark, sf))


@query("metric_range", f"""
WITH {SAMPLES_SQL}, g AS (SELECT unnest(range(0, {GRID_MINUTES * 60 // GRID_STEP} + 1)) AS slot),
p AS (SELECT DISTINCT series FROM s), x AS (SELECT series, {END_US} - {GRID_MINUTES * 60 * 1_000_000} + slot * {GRID_STEP * 1_000_000} AS ts_us FROM p, g)
SELECT x.series, x.ts_us, s.value FROM x ASOF JOIN s ON s.series = x.series AND s.ts_us <= x.ts_us""")
def metric_range(spark, sf):
    return metrics.on_grid(samples(spark, sf), END_US, GRID_MINUTES, GRID_STEP)


@query("metric_counter", f"WITH {COUNTERS_SQL} SELECT series, ts_us, value FROM c")
def metric_counter(spark, sf):
    return counters(spark, sf)


RATES_SQL = f"""{COUNTERS_SQL},
r AS (SELECT series, ts_us, CAST(value - first_value(value) OVER w AS DOUBLE) * 1000000 / (ts_us - first_value(ts_us) OVER w) AS rate, ts_us - first_value(ts_us) OVER w AS elapsed
  FROM c WINDOW w AS (PARTITION BY series ORDER BY ts_us RANGE BETWEEN {RATE_WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW))
"""


@query("metric_rate", f"WITH {RATES_SQL} SELECT series, ts_us, rate FROM r WHERE elapsed > 0")
def metric_rate(spark, sf):
    return metrics.counter_rates(counters(spark, sf), RATE_WINDOW)


@query("metric_rate_resets", f"""
WITH {SAMPLES_SQL}, d AS (SELECT series, ts_us, cents, CASE WHEN cents < lag(cents) OVER o THEN cents ELSE coalesce(cents - lag(cents) OVER o, 0) END AS step FROM s WINDOW o AS (PARTITION BY series ORDER BY ts_us)),
r AS (SELECT series, ts_us, sum(step) OVER w - first_value(step) OVER w AS grown, ts_us - first_value(ts_us) OVER w AS elapsed
  FROM d WINDOW w AS (PARTITION BY series ORDER BY ts_us RANGE BETWEEN {RATE_WINDOW * 1_000_000 - 1} PRECEDING AND CURRENT ROW))
SELECT series, ts_us, CAST(grown AS DOUBLE) * 1000000 / elapsed AS rate FROM r WHERE elapsed > 0""")
def metric_rate_resets(spark, sf):
    """Raw values as a counter: every drop is a reset."""
    return metrics.counter_rates(samples(spark, sf).select("series", "ts_us", F.col("cents").alias("value")), RATE_WINDOW)


@query("metric_busy", f"""WITH {RATES_SQL}, n AS (SELECT series, arg_max(rate, ts_us) AS rate FROM r WHERE elapsed > 0 GROUP BY series)
SELECT round(100.0 - avg(rate) * 100, 6) AS busy, count(*) AS series FROM n""")
def metric_busy(spark, sf):
    return metrics.busy(metrics.counter_rates(counters(spark, sf), RATE_WINDOW)).withColumn("busy", F.round("busy", 6))


RATIO_SQL = f"""{SAMPLES_SQL},
u AS (SELECT series, arg_max(value, ts_us) FILTER (metric = 'purchase') AS used, arg_max(value, ts_us) FILTER (metric = 'view') AS free FROM s GROUP BY series),
q AS (SELECT series, used, free, used + free AS total, CASE WHEN used + free <> 0 THEN used / (used + free) * 100 ELSE 0.0 END AS percent FROM u WHERE used IS NOT NULL AND free IS NOT NULL)
"""


@query("metric_ratio", f"WITH {RATIO_SQL} SELECT series, used, free, total, percent FROM q")
def metric_ratio(spark, sf):
    return metrics.ratio(samples(spark, sf), "purchase", "view")


@query("metric_bands", f"""WITH {RATIO_SQL}, b AS (SELECT series, greatest(0.0, least(100.0, percent * 2 - 20)) AS percent FROM q)
SELECT series, percent, CASE WHEN percent > 90 THEN '#ef4444' WHEN percent > 70 THEN '#f59e0b' ELSE '#22c55e' END AS colour FROM b""")
def metric_bands(spark, sf):
    percent, colour = metrics.band(F.col("percent") * 2 - 20)
    return metrics.ratio(samples(spark, sf), "purchase", "view").select("series", percent.alias("percent"), colour.alias("colour"))


@query("metric_scaled", f"""WITH {SAMPLES_SQL}, m AS (SELECT series, CASE WHEN max(value) <> 0 THEN max(value) ELSE 1.0 END AS top FROM s GROUP BY series)
SELECT series, ts_us, top, least(greatest(value, 0.0), top) / top AS scaled FROM s JOIN m USING (series)""")
def metric_scaled(spark, sf):
    return metrics.scaled(samples(spark, sf)).select("series", "ts_us", "top", "scaled")


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Errors are failed logins, sign-ups are successful ones."""
    rows = load(spark, sf, "events").where("event_type IN ('error', 'signup')")
    return rows.select(F.col("user_id").alias("account"), epoch_us(F.col("ts")).alias("ts_us"), (F.col("event_type") == "error").alias("failed"))


_SPAN = FAILURE_WINDOW * 1_000_000


@query("lockouts", f"""WITH f AS (SELECT user_id AS account, epoch_us(ts) AS ts_us, event_type = 'error' AS failed FROM events WHERE event_type IN ('error', 'signup')),
x AS (SELECT account, ts_us, failed, max(CASE WHEN NOT failed THEN ts_us END) OVER (PARTITION BY account ORDER BY ts_us) AS cleared FROM f)
SELECT a.account, a.ts_us, count(*) AS failures, count(*) >= {FAILURE_LIMIT} AS locked
FROM x a JOIN f b ON b.account = a.account AND b.failed AND b.ts_us <= a.ts_us AND b.ts_us > a.ts_us - {_SPAN} AND b.ts_us > coalesce(a.cleared, 0)
WHERE a.failed GROUP BY a.account, a.ts_us""")
def lockouts(spark, sf):
    return lockout.failure_counts(attempts(spark, sf), "account", FAILURE_LIMIT, FAILURE_WINDOW)


@query("lockouts_by_address", f"""WITH f AS (SELECT user_id AS account, epoch_us(ts) AS ts_us FROM events WHERE event_type = 'error')
SELECT a.account, a.ts_us, count(*) AS failures, count(*) >= {FAILURE_LIMIT} AS locked
FROM f a JOIN f b ON b.account = a.account AND b.ts_us <= a.ts_us AND b.ts_us > a.ts_us - {_SPAN} GROUP BY a.account, a.ts_us""")
def lockouts_by_address(spark, sf):
    """Address keys are not cleared by a success."""
    return lockout.failure_counts(attempts(spark, sf), "account", FAILURE_LIMIT, FAILURE_WINDOW, clear_on_success=False)
