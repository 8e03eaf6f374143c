"""What stays in the audit log and in the evidence store, and until when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.text import parse_ts
from sluiceway.policy import MIN_DAYS

CLEARED, KEPT, EXPIRED = "cleared", "immutable_kept", "immutable_expired"


def cutoff(as_of: Column, days: int) -> Column:
    return as_of - F.make_dt_interval(days=F.lit(max(MIN_DAYS, days)))


def classify(log: DataFrame, as_of: Column, days: int, ts: str = "ts") -> DataFrame:
    """Outcome of clearing the log at ``as_of``: mutable records go, immutable ones stay until
    they are ``days`` old; a record without a readable time stays."""
    when = parse_ts(F.col(ts), as_of)
    old = when < cutoff(as_of, days)
    immutable = F.coalesce("immutable", F.lit(False))
    return log.withColumn("outcome", F.when(~immutable, CLEARED).when(old, EXPIRED).otherwise(KEPT))


def counts(classified: DataFrame) -> DataFrame:
    return classified.agg(
        F.count_if(F.col("outcome") == CLEARED).alias("cleared"),
        F.count_if(F.col("outcome") == KEPT).alias("immutable_kept"),
        F.count_if(F.col("outcome") == EXPIRED).alias("immutable_expired"),
        F.count_if(~F.coalesce("immutable", F.lit(False))).alias("clearable"),
        F.count_if(F.coalesce("immutable", F.lit(False))).alias("immutable"),
    )


def apply(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == KEPT).drop("outcome")
