"""Time-series operators over samples ``(series, ts_us, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.operators.ordering import previous, running, slices

US = 1_000_000
# Colour bands of a percentage.
RED_ABOVE, AMBER_ABOVE = 90, 70
RED, AMBER, GREEN = "#ef4444", "#f59e0b", "#22c55e"


def latest(samples: DataFrame, series: str = "series") -> DataFrame:
    """Newest sample per series, combined map-side."""
    return samples.groupBy(series).agg(F.max("ts_us").alias("ts_us"), F.max(F.struct("ts_us", "value"))["value"].alias("value"))


def on_grid(samples: DataFrame, end_us: int, minutes: int = 60, step: int = 30, series: str = "series") -> DataFrame:
    """Value at or before each step of a time grid ending at ``end_us``.

    Each sample belongs to the first grid point not before it, and only the newest per point is
    kept map-side. What remains per series is one row per grid point, whatever the sample rate.
    """
    step_us, start = step * US, end_us - minutes * 60 * US
    points = minutes * 60 // step
    slot = F.greatest(F.ceil((F.col("ts_us") - start) / step_us), F.lit(0)).cast("int")
    newest = samples.where(F.col("ts_us") <= end_us).groupBy(series, slot.alias("slot")).agg(F.max(F.struct("ts_us", "value"))["value"].alias("value"))
    ordered = Window.partitionBy(series).orderBy("slot")
    until = F.coalesce(F.lead("slot").over(ordered) - 1, F.lit(points))
    held = newest.withColumn("until", until).select(series, "value", F.explode(F.sequence("slot", "until")).alias("slot"))
    return held.select(series, (F.lit(start) + F.col("slot").cast("long") * step_us).alias("ts_us"), "value")


def counter_rates(samples: DataFrame, seconds: int = 120, series: str = "series") -> DataFrame:
    """Per-second rate of a counter over the trailing window, at every sample with an earlier one
    in its window. A drop is a reset: the counter restarted from zero. Samples at one instant count in the order of their values.

    Growth since the series began is a running sum. Where a sample's window starts is looked up as of that time: every sample
    asks at the start of its window for the first sample after it. Walking backwards in time that is the newest least sample,
    a running minimum over samples and questions together. Both run over slices of like size, so neither a hot series nor a
    burst within one window ends up in one task.
    """
    span = seconds * US
    instants = samples.groupBy(series, "ts_us").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count(F.lit(1)).alias("n"))
    known = previous(slices(instants, series, "ts_us"), series, "ts_us", "high", "before")
    step = F.when(F.col("low") < F.col("before"), F.col("low")).otherwise(F.coalesce(F.col("low") - F.col("before"), F.lit(0)))
    grown = running(known.withColumn("step", step), series, "ts_us", F.col("step") + F.col("high") - F.col("low"), "total").drop("_part")
    # The growth up to an instant's first sample, and up to its last.
    moments = grown.select(series, "ts_us", "n", "total", (F.col("total") - (F.col("high") - F.col("low"))).alias("opening"))
    roles = F.array(F.struct((F.col("ts_us") * -2 + 1).alias("at"), F.lit(False).alias("asks")),
                    F.struct(((F.col("ts_us") - span) * -2).alias("at"), F.lit(True).alias("asks")))
    both = moments.withColumn("role", F.explode(roles)).select("*", "role.at", "role.asks").drop("role")
    sample = F.when(~F.col("asks"), F.struct("ts_us", "opening"))
    answered = running(slices(both, series, "at"), series, "at", sample, "first", "min").where("asks")
    elapsed = F.col("ts_us") - F.col("first.ts_us")
    rate = (F.col("total") - F.col("first.opening")).cast("double") * US / elapsed
    return answered.where(elapsed > 0).select(series, "ts_us", rate.alias("rate"), F.explode(F.array_repeat(F.lit(0), F.col("n").cast("int")))).drop("col")


def busy(rates: DataFrame, series: str = "series") -> DataFrame:
    """100 minus the mean idle rate (in percent) over the newest rate of each series."""
    newest = rates.groupBy(series).agg(F.max_by("rate", "ts_us").alias("rate"))
    return newest.agg((F.lit(100.0) - F.avg("rate") * 100).alias("busy"), F.count(F.lit(1)).alias("series"))


def ratio(samples: DataFrame, used: str, free: str, labels: str = "series") -> DataFrame:
    """used / (used + free) in percent, matching two metrics on their labels; 0 when both are 0."""
    def newest(metric: str) -> Column:
        return F.max(F.when(F.col("metric") == metric, F.struct("ts_us", "value")))["value"]

    pair = samples.groupBy(labels).agg(newest(used).alias("used"), newest(free).alias("free")).where("used IS NOT NULL AND free IS NOT NULL")
    total = F.col("used") + F.col("free")
    return pair.withColumn("total", total).withColumn("percent", F.when(total != 0, F.col("used") / total * 100).otherwise(F.lit(0.0)))


def scaled(samples: DataFrame, top: float | None = None, series: str = "series") -> DataFrame:
    """Values clamped to [0, top] and divided by it; top defaults to the series' maximum (or 1)."""
    if top:
        with_top = samples.withColumn("top", F.lit(float(top)))
    else:
        tops = samples.groupBy(series).agg(F.max("value").alias("m"))
        with_top = samples.join(tops, series).withColumn("top", F.when(F.col("m") != 0, F.col("m")).otherwise(F.lit(1.0))).drop("m")
    return with_top.withColumn("scaled", F.least(F.greatest("value", F.lit(0.0)), F.col("top")) / F.col("top"))


def band(percent: Column) -> tuple[Column, Column]:
    """(clamped percentage, colour)."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), percent))
    return clamped, F.when(clamped > RED_ABOVE, RED).when(clamped > AMBER_ABOVE, AMBER).otherwise(GREEN)
