"""Response texts: extraction from nested responses and assembly of streamed pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.functions import json_text
from sluiceway.operators.ordering import running_sum

# Fixed values.
REASONING_FIELDS = ("reasoning_content", "reasoning", "thinking", "refusal")
MAX_OUTPUT_CHARS = 400_000
MAX_OUTPUT_CHUNKS = 20_000
MESSAGE = "struct<content:variant, reasoning_content:variant, reasoning:variant, thinking:variant, refusal:variant, tool_calls:variant>"
CHOICES = f"array<struct<index:int, message:{MESSAGE}, delta:{MESSAGE}>>"


def response_texts(responses: DataFrame) -> DataFrame:
    """``(call_id, choice, field, text)``: content, reasoning fields and tool calls of every choice."""
    choice = responses.select("call_id", F.posexplode(F.from_json("choices_json", CHOICES)).alias("choice", "c"))
    message = choice.select("call_id", "choice", F.coalesce("c.message", "c.delta").alias("m"))
    fields = ("content", *REASONING_FIELDS)
    parts = message.select(
        "call_id", "choice",
        F.posexplode(F.array(*[json_text.content(F.col(f"m.{name}")) for name in fields], json_text.tool_calls(F.col("m.tool_calls")))).alias("field", "text"),
    )
    return parts.where(F.length("text") > 0)


def unreadable(responses: DataFrame) -> DataFrame:
    """Responses whose choices are no readable JSON. They are withheld (extraction_failure), never passed."""
    return responses.where(F.col("choices_json").isNotNull() & F.try_parse_json("choices_json").isNull())


def over_caps(pieces: DataFrame, key: str = "call_id", text: str = "piece", max_chars: int = MAX_OUTPUT_CHARS, max_chunks: int = MAX_OUTPUT_CHUNKS) -> DataFrame:
    """Calls over the size caps, which are refused (output_buffer_cap), from counts and lengths alone (combined map-side)."""
    return pieces.groupBy(key).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length(text)).alias("chars")).where(
        (F.col("chars") > max_chars) | (F.col("chunks") > max_chunks)
    )


def assemble(pieces: DataFrame, group: list[str], order: str, text: str = "piece", separator: str = "") -> DataFrame:
    """Pieces joined in order per group, whatever their number: a group is one text in the end. Whether a call is over the
    size caps, and so withheld, is decided by ``decisions.decide_outputs`` with ``over_caps``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("piece"))))
    return pieces.groupBy(*group).agg(ordered.alias("p")).select(
        *group, F.array_join(F.transform("p", lambda x: x["piece"]), separator).alias("text"), F.size("p").alias("pieces")
    )


def assembled_chunks(pieces: DataFrame, key: str, at: str, text: str, size: int = 6000, overlap: int = 600, bucket: int = 1000) -> DataFrame:
    """Overlapping chunks of the texts that ordered pieces make, joined by line breaks, without putting a text together.

    Each piece gets its offset by running sums over buckets of ``bucket`` positions, goes to the chunks it overlaps, and a chunk
    gathers its own parts: ``size`` characters at most. ``at`` is an integer and unique per key.
    """
    step = max(size - overlap, size // 2)
    sized = pieces.withColumn("_len", (F.length(text) + 1).cast("long"))
    placed = running_sum(sized, key, at, "_len", "_end", bucket).withColumn("_start", F.col("_end") - F.col("_len"))
    # The break before a piece belongs to it; the first piece has none.
    begin = F.greatest(F.col("_start") - 1, F.lit(0))
    joined = placed.select(key, F.when(F.col("_start") > 0, F.concat(F.lit("\n"), F.col(text))).otherwise(F.col(text)).alias("_text"), begin.alias("_from"))
    last = F.floor((F.col("_from") + F.length("_text") - 1) / step)
    first = F.greatest(F.floor((F.col("_from") - size) / step) + 1, F.lit(0))
    skip = lambda k: F.greatest(k * step - F.col("_from"), F.lit(0))
    upto = lambda k: F.least(k * step + size - F.col("_from"), F.length("_text"))
    # Parts are cut before they become rows, so a row never carries its whole piece.
    cut = F.transform(F.sequence(first, last), lambda k: F.struct(k.cast("int").alias("chunk_idx"), F.struct(
        F.col("_from"), F.substring(F.col("_text"), (skip(k) + 1).cast("int"), (upto(k) - skip(k)).cast("int")).alias("part")).alias("p")))
    parts = joined.select(key, F.explode(cut).alias("c")).select(key, "c.*")
    whole = parts.groupBy(key, "chunk_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.part), "").alias("chunk"))
    return whole.where(F.col("chunk").rlike(r"(?U)\S"))
