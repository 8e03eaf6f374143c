"""Ordered computations over groups that may hold a large share of all rows.

A window partitioned by such a group would sort it in one task. These helpers split every group by
position or time first and carry only small per-piece summaries across the pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.session import cut


def number_rows(rows: DataFrame, group: str, order: list[str], into: str = "seq") -> DataFrame:
    """0-based position of each row within its group by ``order`` (which must be unique).

    A range-partitioned global sort spreads a large group over many tasks. Positions are the
    partition's offset plus the row's place in it, and a group's positions start at its first row.
    The sorted rows are materialised once, so a lost executor cannot renumber them.
    """
    placed = cut(rows.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # One row per partition of the sort: bounded by spark.sql.shuffle.partitions, safe to broadcast.
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    row = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn("_pos", F.col("_before") + row)
    starts = numbered.groupBy(group).agg(F.min("_pos").alias("_start"))
    return numbered.join(starts, group).withColumn(into, F.col("_pos") - F.col("_start")).drop(
        "_at", "_part", "_before", "_pos", "_start"
    )


def running_sum(rows: DataFrame, group: str, at: str, value: str, into: str, bucket: int) -> DataFrame:
    """Sum of ``value`` up to and including each row of its group, by integer position ``at``.

    Groups are cut into buckets of ``bucket`` positions; each bucket is summed on its own and
    starts from the total of the earlier buckets of its group. Rows at one position share their sum.
    """
    bucketed = rows.withColumn("_b", F.floor(F.col(at) / bucket))
    totals = bucketed.groupBy(group, "_b").agg(F.sum(value).alias("_t"))
    earlier = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(group, "_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_carry"))
    inside = Window.partitionBy(group, "_b").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    summed = bucketed.withColumn("_inside", F.sum(value).over(inside))
    return summed.join(carried, [group, "_b"]).withColumn(into, F.col("_carry") + F.col("_inside")).drop("_b", "_carry", "_inside")


def slices(rows: DataFrame, group: str, at: str) -> DataFrame:
    """Rows range-partitioned by group and position, with their partition as ``_part``, materialised once.

    A slice is what one partition holds of one group. Partitions are cut by a sample of the rows, so they are of like size
    however the rows lie over the groups and however densely over the positions; rows at one position of a group stay together.
    """
    placed = cut(rows.repartitionByRange(group, at).withColumn("_part", F.spark_partition_id()))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartitionById(parts, F.col("_part"))


def _with_carry(sliced: DataFrame, group: str, total: Column, combine: Callable[[Column], Column]) -> DataFrame:
    """Adds ``_carry``: ``combine`` of the totals of the group's earlier slices, NULL in its first slice.

    A partition continues at most one group from the one before it, so there is at most one carry for each partition: bounded by
    spark.sql.shuffle.partitions, safe to broadcast.
    """
    totals = sliced.groupBy("_part", group).agg(total.alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_part")
    before = combine(F.col("_total")).over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    carries = totals.select(
        F.col("_part").alias("_p"), F.col(group).alias("_g"), before.alias("_carry"), F.row_number().over(earlier).alias("_n")
    ).where("_n > 1").drop("_n")
    same = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))
    return sliced.join(F.broadcast(carries), same, "left").drop("_p", "_g")


def running(sliced: DataFrame, group: str, at: str, value: Column, into: str, how: str = "sum") -> DataFrame:
    """Sum, least or greatest ``value`` of a group's rows up to and including each position. Rows without a value add
    nothing; before the first value the result is NULL."""
    combine = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    valued = sliced.withColumn("_value", value)
    inside = combine("_value").over(Window.partitionBy("_part", group).orderBy(at).rangeBetween(Window.unboundedPreceding, 0))
    summed = _with_carry(valued, group, combine("_value"), combine).withColumn("_inside", inside)
    if how == "sum":
        both = F.coalesce(F.col("_carry") + F.col("_inside"), "_carry", "_inside")
    else:
        both = (F.least if how == "min" else F.greatest)("_carry", "_inside")
    return summed.withColumn(into, both).drop("_value", "_carry", "_inside")


def previous(sliced: DataFrame, group: str, at: str, value: str, into: str) -> DataFrame:
    """``value`` of the row before each row of its group; positions must be unique in a group."""
    newest = F.max(F.struct(at, F.col(value).alias("v")))
    before = F.lag(F.struct(at, F.col(value).alias("v"))).over(Window.partitionBy("_part", group).orderBy(at))
    carried = _with_carry(sliced, group, newest, F.max).withColumn("_before", before)
    return carried.withColumn(into, F.coalesce("_before", "_carry")["v"]).drop("_carry", "_before")
