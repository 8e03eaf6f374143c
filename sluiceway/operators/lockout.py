"""Sliding failure counts and the lockouts they cause."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.ordering import running, slices

# Fixed values: (failures, seconds) per account and per address.
ACCOUNT_LIMIT = (5, 300)
ADDRESS_LIMIT = (20, 900)
US = 1_000_000


def failure_counts(attempts: DataFrame, key: str, limit: int, seconds: int, clear_on_success: bool = True) -> DataFrame:
    """Failures in the trailing window at every failure, and whether the key is then locked.

    ``attempts`` is ``(key, ts_us, failed)``. A success clears what came before it (account keys
    do, address keys do not). Attempts at one instant are merged map-side. Every failure counts once more, negatively,
    at the instant it leaves the window, so the count in the window is a running sum, and running sums are taken over slices
    of like size: a key under attack spreads over many tasks, also when all its attempts lie in one window.
    """
    merged = attempts.groupBy(key, "ts_us").agg(
        F.count_if(F.col("failed")).alias("n"), F.bool_or(~F.col("failed")).alias("success")
    )
    leaving = merged.where("n > 0").select(
        key, (F.col("ts_us") + seconds * US).alias("ts_us"), (-F.col("n")).alias("n"), F.lit(None).cast("boolean").alias("success")
    )
    counted = running(slices(merged.unionByName(leaving), key, "ts_us"), key, "ts_us", F.col("n"), "recent")
    if clear_on_success:
        counted = running(counted, key, "ts_us", F.greatest("n", F.lit(0)), "seen")
        counted = running(counted, key, "ts_us", F.when(F.col("success"), F.col("seen")), "cleared", "max")
        failures = F.least(F.col("recent"), F.col("seen") - F.coalesce("cleared", F.lit(0)))
    else:
        failures = F.col("recent")
    return (
        counted.where("n > 0").select(key, "ts_us", failures.alias("failures"), (failures >= limit).alias("locked"))
    )
