"""Release of held calls on the classifier's verdicts, as one declarative stream.

A held call is cut into the parts that the classifier judges. The parts are joined with the stream of verdicts, left outer and within a
time: a verdict that does not come while the watermark passes is a missing one. The parts of a call are then gathered; a call goes on
only if every part has a readable verdict that blocks nothing. Spark keeps the state of both steps and drops it by watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.operators import verdicts
from sluiceway.operators.requests import chunk_parts, has_text
from sluiceway.policy import Policy

WAIT = "10 minutes"  # from a call's end to its last verdict
LATE = "1 minute"  # how late rows of either stream may be


def parts_of(held: DataFrame, size: int, overlap: int) -> DataFrame:
    """(call_id, part_idx, ended_at, text, held): the parts of each call that the classifier is asked about. ``held``, the call itself, is with part 0 only, so that
    its texts are in the state once. A call without text has part 0 and no text."""
    spoken = F.array_join(F.filter(F.transform("outputs", lambda o: o.text), lambda t: F.length(F.trim(t)) > 0), "\n")
    whole = held.select("call_id", "ended_at", F.struct("reason", "chunks", "chars", "outputs").alias("_held"), F.coalesce(spoken, F.lit("")).alias("_text"))
    parts = whole.select("call_id", "ended_at", "_held", F.posexplode_outer(chunk_parts(F.col("_text"), size, overlap)).alias("part_idx", "text"))
    parts = parts.withColumn("part_idx", F.coalesce("part_idx", F.lit(0))).where((F.col("part_idx") == 0) | has_text(F.col("text")))
    return parts.select("call_id", "part_idx", "ended_at", "text", F.when(F.col("part_idx") == 0, F.col("_held")).alias("held"))


def judge(held: DataFrame, answers: DataFrame, policy: Policy, wait: str = WAIT, late: str = LATE, size: int = 6000, overlap: int = 600) -> DataFrame:
    """Held calls with ``verdict``, the reason to withhold them, or null where the classifier lets them pass.

    ``held``: a stream of (call_id, reason, chunks, chars, ended_at, outputs); ``answers``: a stream of (call_id, part_idx, judged_at, model, raw). Of several answers to one
    part the worst counts, of several bad parts the blocked one before the unread one, then the first. A part whose answer comes more than ``wait`` after the call's end, or
    not at all, is ``guard_unavailable``.
    """
    asked = parts_of(held, size, overlap).withWatermark("ended_at", late).alias("h")
    told = answers.withWatermark("judged_at", late).alias("v")
    same = (F.col("h.call_id") == F.col("v.call_id")) & (F.col("h.part_idx") == F.col("v.part_idx"))
    in_time = (F.col("v.judged_at") >= F.col("h.ended_at")) & (F.col("v.judged_at") <= F.col("h.ended_at") + F.expr(f"INTERVAL {wait}"))
    met = asked.join(told, same & in_time, "leftOuter")
    verdict = F.when(F.col("v.call_id").isNotNull(), verdicts.parse(F.col("v.model"), F.col("v.raw")))
    own = met.select("h.call_id", "h.ended_at", "h.part_idx", "h.held", verdicts.outcome(verdict, policy).alias("o"))
    worst = F.min(F.struct(F.col("o.rank").alias("rank"), F.col("part_idx").alias("part_idx"), F.col("o.reason").alias("reason"), F.col("o.codes").alias("codes")))
    # The call's end is the event time: its group is final once the watermark has passed it and the join can add nothing.
    calls = own.groupBy("call_id", "ended_at").agg(F.first("held", ignorenulls=True).alias("held"), worst.alias("worst"), F.max("part_idx").alias("last"))
    return calls.select("call_id", "held.reason", "held.chunks", "held.chars", "ended_at", "held.outputs",
                        F.when(F.col("worst.rank") < 2, F.col("worst.reason")).alias("verdict"), F.col("worst.codes").alias("codes"), (F.col("last") + 1).alias("parts"))
