"""Mixing sources to target weights, as a curriculum that changes over the training run.

Sizes are in words. Sources share the words of all documents by weight; a source's target stops at ``repeats`` times its size,
and what it cannot take is shared by weight among the others (water filling, in closed form). Each source has a schedule:
its demand as a piecewise linear density over training time. The integral of the density up to a time, scaled to the target, is
how many of the source's words the run has used by then; its inverse gives each document the time at which its turn comes,
and so a position in the whole run. Sorting the documents by position gives the training order.

A source is read in passes, each in another pseudo-random order. The last document that a source gives is taken in
part, so that the words taken equal the target (rounded to whole words).

No group is handled whole: documents are dealt into buckets by a digest of their key, bucket totals are summed first, and only
inside a bucket are rows ordered. A bucket has about max(2000, square root of all rows) rows, so both the number of buckets and their size stay
small. Text moves once for the plan and once for the final range sort.

Defined cases: a null or empty text has size 0 and takes nothing; a null source is a source of its own, the last one. Repeated rows
are rows of their own; rows that share key and size are ordered by a hash of the text, so reruns agree. An empty table gives an empty result.
Input columns named like an output are replaced. A null key is ordered like the empty string.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import count_words, without

WEIGHTS = (5, 2, 1)  # by rank of the source, repeating
REPEATS = 3
# Knots (time, density) by rank of the source, repeating: falling, even and rising demand.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
ROWS_PER_BUCKET = 2000


def shares(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_rank, source_size, weight, total, target) from rows (source, size): one row per source.

    Sources are filled up in the order of limit by weight. Before each, the words not yet given out, divided by the weights
    not yet served, are a level; the highest of these levels is the final one.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ranked = sources.withColumn("source_rank", rank)
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_rank"), F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumns({"weight": weight, "limit": F.col("source_size") * repeats})
    all_rows = Window.partitionBy()
    filled = Window.orderBy(F.col("limit") / F.col("weight"), "source_rank")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    onward = filled.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(all_rows)
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0))).cast("double") / F.sum("weight").over(onward)
    levelled = ranked.withColumns({"total": total, "level": level})
    target = F.least(F.col("limit").cast("double"), F.col("weight") * F.max("level").over(all_rows))
    return levelled.select("source", "source_rank", "source_size", "weight", "total", target.alias("target"))


def segments(schedule) -> list[tuple[float, float, float, float]]:
    """(integral before, start, density at start, slope) of each piece of a schedule, the integral scaled to 1 at the end."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))
    out, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:]):
        out.append((done, t0, w0 / whole, (w1 - w0) / (t1 - t0) / whole))
        done += (t1 - t0) * (w0 + w1) / 2 / whole
    return out


def when_used(share: Column, schedules: Column) -> Column:
    """Time at which a source has used ``share`` of its target; ``schedules``: its pieces as an array of structs."""
    at = F.element_at(F.filter(schedules, lambda s: s.before <= share), -1)
    y = share - at["before"]
    # Null only at the start of a piece whose density starts at 0.
    later = F.try_divide(F.lit(2.0) * y, at["density"] + F.sqrt(at["density"] * at["density"] + F.lit(2.0) * at["slope"] * y))
    return at["start"] + F.coalesce(later, F.lit(0.0))


def _digest(number, key: Column) -> Column:
    return F.md5(F.concat(F.lit(str(number) if isinstance(number, int) else number), F.lit(":"), key))


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", size: Column | None = None,
         weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """``docs`` with size, source_size, target, taken (words, all passes together) and copies: an array with, for each
    pass that takes something of the document, (pass, take, position). One row in, one row out."""
    added = ("size", "source_size", "target", "taken", "copies")
    rows = without(docs, [a for a in added if a != text])
    names = rows.columns
    words = count_words(text) if size is None else size
    tie = F.xxhash64(text) if text in names else F.lit(0)
    rows = rows.withColumns({"size": words, "_tie": tie, "_key": F.coalesce(F.col(key).cast("string"), F.lit("")), "_source": F.col(source)})
    count = rows.count()
    buckets = max(1, -(-count // max(ROWS_PER_BUCKET, math.isqrt(count))))
    rows = rows.withColumn("_bucket", (F.conv(F.substring(F.md5("_key"), 1, 8), 16, 10).cast("long") % buckets).cast("int"))

    table = shares(rows.select(F.col("_source").alias("source"), "size"), weights, repeats)
    kinds = F.array(*[F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(piece, ("before", "start", "density", "slope"))])
                                for piece in segments(s)]) for s in schedules])
    pieces = F.element_at(kinds, F.pmod(F.col("source_rank"), F.lit(len(schedules))).cast("int") + 1)
    totals = rows.groupBy("_source", "_bucket").agg(F.sum("size").alias("_sum"))
    for p in range(repeats):  # each pass goes through the buckets in an order of its own
        earlier = Window.partitionBy("_source").orderBy(_digest(p, F.col("_bucket").cast("string"))).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn(f"_start{p}", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    table = table.withColumn("pieces", pieces)
    totals = totals.join(table, F.col("_source").eqNullSafe(F.col("source"))).select(
        F.col("_source").alias("_s"), F.col("_bucket").alias("_b"), "source_size", "target", "total", "pieces", *[f"_start{p}" for p in range(repeats)])
    joined = rows.join(totals, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))

    goal = F.floor(F.col("target") + 0.5)
    copies = []
    for p in range(repeats):
        inside = Window.partitionBy("_source", "_bucket").orderBy(_digest(p, F.col("_key")), "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
        start = F.lit(p) * F.col("source_size") + F.col(f"_start{p}") + F.coalesce(F.sum("size").over(inside), F.lit(0))
        joined = joined.withColumn(f"_at{p}", start)
        take = F.greatest(F.lit(0), F.least(F.col("size"), goal - F.col(f"_at{p}")))
        position = F.col("total") * when_used(F.col(f"_at{p}") / F.col("target"), F.col("pieces"))
        copies.append(F.when(take > 0, F.struct(F.lit(p).alias("pass"), take.alias("take"), position.alias("position"))))
    joined = joined.withColumn("copies", F.filter(F.array(*copies), lambda c: c.isNotNull()))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda sum_, c: sum_ + c["take"])
    return joined.select(*[F.col(f"`{n}`") for n in names], "size", "source_size", "target", taken.alias("taken"), "copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The training set in training order: the columns of ``docs`` and ``position``, a row for each time that a document is
    taken, range-sorted by position. A document taken in part is given whole if at least half of it is taken."""
    names = [c for c in docs.columns if c.lower() != "position"]
    copies = plan(docs, key, text, source, **options).withColumn("_copy", F.explode("copies"))
    whole = copies.where(F.col("_copy.take") * 2 >= F.col("size"))
    placed = whole.select(*[F.col(f"`{n}`") for n in names], F.col("_copy.position").alias("position"), F.col("_copy.pass").alias("_pass"))
    order = ["position", key, "_pass"]  # positions of unlike sources may be equal
    return placed.repartitionByRange(*order).sortWithinPartitions(*order).drop("_pass")
