"""From hits and verdicts to one fail-closed decision per request and per response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.operators.requests import chunk_count, has_text

MAX_CHUNKS = 100  # fixed value: classifier calls a request may need
# Refusal reason -> (status, code).
OUTCOMES = {
    "schema_budget_exceeded": (413, "veto_triggered"),
    "no_scannable_text": (400, "veto_triggered"),
    "regex_budget_exhausted": (400, "veto_triggered"),
    "prompt_too_long_for_guard": (413, "prompt_too_long_for_guard"),
    "guard_verdict_unparseable": (503, "guard_verdict_unparseable"),
    "guard_no_adapter": (503, "guard_no_adapter"),
    "guard_unavailable": (503, "guard_unavailable"),
    "classifier": (400, "veto_triggered"),
    "no_scannable_output": (400, "veto_triggered"),
    "extraction_failure": (500, "safety_processing_error"),
    "output_buffer_cap": (400, "veto_triggered"),
}


def outcome_of(reason: Column) -> tuple[Column, Column]:
    """(status, code) of a refusal reason; no reason is a pass, an unknown one still refuses."""
    status = F.when(reason.isNull(), F.lit(200))
    code = F.when(reason.isNull(), F.lit("pass"))
    for name, (number, text) in OUTCOMES.items():
        status, code = status.when(reason == name, F.lit(number)), code.when(reason == name, F.lit(text))
    return status.otherwise(F.lit(400)), code.otherwise(F.lit("veto_triggered"))


def decide(requests: DataFrame, key: str, hits: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Decision rows of all requests.

    ``hits`` is one row per hit request (``list, pattern, span``), ``verdicts`` one row per scored
    request (``refused, reason, codes``). Tripwires come first; a request with neither a hit nor a
    verdict was not evaluated and is refused. Both sides are unique per key, so a request never
    multiplies.
    """
    joined = requests.join(hits, key, "left").join(
        verdicts.select(key, "refused", F.col("reason").alias("verdict_reason"), "codes"), key, "left"
    )
    reason = (
        F.when(F.col("list").isNotNull(), F.concat(F.lit("regex:"), F.col("list")))
        .when(F.col("refused").isNull(), F.lit("guard_unavailable"))
        .when(F.col("refused"), F.coalesce(F.col("verdict_reason"), F.lit("guard_unavailable")))
    )
    out = joined.withColumn("reason", reason)
    status, code = outcome_of(F.col("reason"))
    return out.withColumn("status", status).withColumn("code", code)


def decide_requests(requests: DataFrame, key: str, texts: DataFrame, hits: DataFrame, new_chars: DataFrame, verdicts: DataFrame,
                    unreadable: DataFrame | None = None, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(key, reason, status, code) of every request, the first of these that holds: it cannot be read; it has a payload (``has_payload``)
    but no text; a text hits a list; what is new in it needs over ``max_chunks`` classifier calls; its verdict. A request
    without payload and text passes.

    ``texts``: scannable texts. ``hits``: one row per hit request. ``new_chars``: (key, chars) of the text new to the classifier. ``verdicts``:
    one row per scored request. Every side is reduced to one row per request before it is joined.
    """
    has_text = texts.groupBy(key).agg(F.lit(True).alias("_text"))
    long = new_chars.where(chunk_count(F.col("chars")) > max_chunks).groupBy(key).agg(F.lit(True).alias("_long"))
    broken = (unreadable.groupBy(key) if unreadable is not None else requests.limit(0).groupBy(key)).agg(F.lit(True).alias("_broken"))
    joined = requests.join(has_text, key, "left").join(long, key, "left").join(broken, key, "left").join(hits.select(key, "list"), key, "left").join(
        verdicts.select(key, "refused", F.col("reason").alias("_verdict")), key, "left")
    reason = (
        F.when(F.col("_broken"), "extraction_failure")
        .when(F.col("_text").isNull() & F.col("has_payload"), "no_scannable_text")
        .when(F.col("_text").isNull(), F.lit(None).cast("string"))
        .when(F.col("list").isNotNull(), F.concat(F.lit("regex:"), F.col("list")))
        .when(F.col("_long"), "prompt_too_long_for_guard")
        .when(F.coalesce("refused", F.lit(True)), F.coalesce("_verdict", F.lit("guard_unavailable")))
    )
    out = joined.select(key, reason.alias("reason"))
    status, code = outcome_of(F.col("reason"))
    return out.withColumn("status", status).withColumn("code", code)


TOO_LONG = "OUTPUT_TOO_LONG_FOR_GUARD"  # fixed value: the code of a response that needs too many classifier calls


def decide_outputs(responses: DataFrame, key: str, texts: DataFrame, hits: DataFrame, verdicts: DataFrame, over: DataFrame, unreadable: DataFrame,
                   max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """(key, reason, status, code, codes) of every response, the first of these that holds: it is over the size caps (``over``); it cannot be
    read; it has no text, and passes; a text hits a list; it needs over ``max_chunks`` classifier calls; its verdict, where a missing one withholds.

    ``texts``: (key, text) of what the response says, decoded fragments included. ``hits`` and ``verdicts``: one row per hit or judged response. All sides
    become facts of one table, combined map-side in one aggregate, so no side is joined. Rows of keys that are no response have no effect.
    """
    fields = {"response": "boolean", "over": "boolean", "broken": "boolean", "chars": "long", "list": "string",
              "judged": "struct<refused:boolean, reason:string, codes:array<string>>"}

    def facts(rows: DataFrame, **given: Column) -> DataFrame:
        return rows.select(key, *[given.get(name, F.lit(None)).cast(kind).alias(f"_{name}") for name, kind in fields.items()])

    yes = F.lit(True)
    sized = texts.where(has_text(F.col("text"))).groupBy(key).agg((F.sum(F.length("text") + 1) - 1).alias("_n"))
    sides = [facts(responses, response=yes), facts(over, over=yes), facts(unreadable, broken=yes), facts(sized, chars=F.col("_n")),
             facts(hits, list=F.col("list")), facts(verdicts, judged=F.struct("refused", "reason", "codes"))]
    known = sides[0]
    for side in sides[1:]:
        known = known.unionByName(side)
    each = known.groupBy(key).agg(*[F.max(f"_{name}").alias(f"_{name}") for name in fields]).where("_response")
    too_long = chunk_count(F.col("_chars")) > max_chunks
    reason = (
        F.when(F.col("_over"), "output_buffer_cap").when(F.col("_broken"), "extraction_failure").when(F.col("_chars").isNull(), F.lit(None).cast("string"))
        .when(F.col("_list").isNotNull(), F.concat(F.lit("regex:"), "_list")).when(too_long, "classifier")
        .when(F.coalesce("_judged.refused", yes), F.coalesce("_judged.reason", F.lit("guard_unavailable")))
    )
    codes = F.when(F.col("reason") == "classifier", F.when(too_long, F.array(F.lit(TOO_LONG))).otherwise(F.col("_judged.codes")))
    status, code = outcome_of(F.col("reason"))
    return each.withColumn("reason", reason).select(key, "reason", status.alias("status"), code.alias("code"), codes.alias("codes"))
