"""Image workflows: string inputs, file gate, output gate, signatures and their matching."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sluiceway.functions.columns import bind, let
from sluiceway.functions.text import base_name
from sluiceway.policy import IMAGE_CATEGORY_NAMES, category_names

# Fixed values.
VERDICT_FIELDS = ("nsfw", "sexual_content", "minor_present", "sexual_minor", "illegal", "violence_gore")
WORKFLOW = "map<string, struct<class_type:string, inputs:map<string,variant>>>"
DESCRIPTION_CHARS = 120
GATE_TEXT_CHARS = 60_000
KEEP, NSFW, ILLEGAL, UNREADABLE = "keep", "destroy_nsfw", "destroy_illegal", "destroy_unparseable"


def string_inputs(workflows: DataFrame) -> DataFrame:
    """``(workflow_id, pos, node, class_type, input, value)`` of every string input of every node."""
    nodes = workflows.select("workflow_id", F.explode(F.from_json("workflow_json", WORKFLOW)).alias("node", "n"))
    inputs = nodes.select("workflow_id", "node", F.col("n.class_type").alias("class_type"), F.posexplode("n.inputs").alias("at", "input", "v"))
    return inputs.where(F.schema_of_variant("v") == "STRING").select(
        "workflow_id", F.struct("node", "at").alias("pos"), "node", "class_type", "input", F.variant_get("v", "$", "string").alias("value")
    )


def distinct_refs(refs: DataFrame, workflow: str, name: str, pos: str) -> DataFrame:
    """Distinct references of a workflow with their first position, combined map-side."""
    return refs.groupBy(workflow, name).agg(F.min(pos).alias("first_pos"))


def file_refs(inputs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Inputs that name a file of the store."""
    named = inputs.withColumn("name", base_name(F.col("value")))
    return named.join(inventory.select("name").distinct(), "name", "left_semi")


def text_inputs(inputs: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every other non-blank string input: prompts and whatever a custom node carries."""
    named = inputs.withColumn("name", base_name(F.col("value"))).where(F.col("value").rlike(r"(?U)\S"))
    return named.join(inventory.select("name").distinct(), "name", "left_anti")


def foreign_inputs(refs: DataFrame, owned: DataFrame, keys: list[str]) -> DataFrame:
    """References to inputs the requester does not own; an unowned one counts as foreign."""
    return refs.join(owned.select(*keys).distinct(), keys, "left_anti")


def file_gate(workflows: DataFrame, refs: DataFrame, registry: DataFrame, workflow: str, name: str, pos: str) -> DataFrame:
    """Workflows with whether they may run and, if not, the reason: their first offending file.

    ``workflows`` carries the requester's grants (``nsfw_grant``, ``admin``), ``registry`` is
    ``(name, nsfw)``; a file that is not registered is unclassified. A popular file makes one join
    key hot: Spark splits that partition. Only offending references are grouped.
    """
    judged = refs.join(workflows.select(workflow, "nsfw_grant", "admin"), workflow).join(registry.select(name, "nsfw"), name, "left")
    flag, shown = F.coalesce("nsfw", F.lit("unclassified")), F.col(name).cast("string")
    reason = F.when(
        (flag == "yes") & ~F.col("nsfw_grant"), F.concat(shown, F.lit(" is marked NSFW and your account does not have the NSFW grant"))
    ).when((flag == "unclassified") & ~F.col("admin"), F.concat(shown, F.lit(" has not been classified by an administrator yet")))
    offending = judged.select(workflow, pos, reason.alias("reason")).where("reason IS NOT NULL")
    first = offending.groupBy(workflow).agg(F.min(F.struct(pos, "reason"))["reason"].alias("reason"))
    return workflows.select(workflow).join(first, workflow, "left").withColumn("allowed", F.col("reason").isNull())


def allowed_names(registry: DataFrame, nsfw_grant: bool, admin: bool = False) -> DataFrame:
    """Registered names an account may choose."""
    if admin:
        return registry
    return registry.where((F.col("nsfw") == "no") | (F.lit(nsfw_grant) & (F.col("nsfw") == "yes")))


def filter_choices(choices: DataFrame, inventory: DataFrame, allowed: DataFrame, name: str) -> DataFrame:
    """Choices limited to allowed names; names outside the inventory pass through."""
    known = choices.join(inventory.select(name).withColumn("known", F.lit(True)), name, "left")
    flagged = known.join(allowed.select(name).withColumn("ok", F.lit(True)), name, "left")
    return flagged.where("known IS NULL OR ok").drop("known", "ok")


def parse_verdict(raw: Column) -> Column:
    """``struct<six booleans, description>`` of a verdict document, NULL unless all six fields are
    real booleans."""
    fields = ", ".join(f"{name}:boolean" for name in VERDICT_FIELDS)
    # Spark's parser stops after the first complete value; a text with more after it is
    # not one JSON value. The closing mark, unknown to whoever wrote the text, proves the whole text was one value.
    mark = F.md5(raw)
    whole = F.concat(F.lit('{"v":'), raw, F.lit(',"end":"'), mark, F.lit('"}'))

    def check(read: Column) -> Column:
        found = read["v"]
        valid = F.coalesce(read["end"] == mark, F.lit(False))
        for name in VERDICT_FIELDS:
            valid = valid & found[name].isNotNull()
        short = F.substring(F.coalesce(found["description"], F.lit("")), 1, DESCRIPTION_CHARS)
        return F.when(valid, F.struct(*[found[name].alias(name) for name in VERDICT_FIELDS], short.alias("description")))

    return let(F.from_json(whole, f"v struct<{fields}, description:string>, end string"), check)


def decide(verdict: Column, nsfw_grant: Column, error: Column | None = None) -> Column:
    """``struct<action, why, code>``; an unreadable verdict destroys the image."""
    def row(action: str, why: Column, code: str | None) -> Column:
        return F.struct(F.lit(action).alias("action"), why.alias("why"), F.lit(code).cast("string").alias("code"))

    adult = verdict["nsfw"] | verdict["sexual_content"]
    unreadable = F.coalesce(error, F.lit("unparseable")) if error is not None else F.lit("unparseable")
    return (
        F.when(verdict.isNull(), row(UNREADABLE, unreadable, "UNPARSEABLE_VERDICT"))
        .when(verdict["sexual_minor"] | (verdict["minor_present"] & adult), row(ILLEGAL, F.lit("sexualised minor"), "S4"))
        .when(verdict["illegal"], row(ILLEGAL, F.lit("illegal content"), "S3"))
        .when((adult | verdict["violence_gore"]) & ~nsfw_grant, row(NSFW, F.lit("NSFW output without the NSFW grant"), "S12"))
        .otherwise(row(KEEP, F.lit(""), None))
    )


def inside_store(path: Column, root: str) -> Column:
    """Whether a path stays below ``root``: no ``..`` part may climb out."""
    return path.startswith(root.rstrip("/") + "/") & ~path.rlike(r"(^|/)\.\.(/|$)")


def worst_verdicts(verdicts: DataFrame, key: list[str]) -> DataFrame:
    """One ``verdict`` per key: the flags of all readable verdicts together; NULL if one was unreadable, unless the others already
    make the image illegal."""
    parsed = bind(verdicts.select(*key, "raw"), "verdict", parse_verdict(F.col("raw")))
    flags = F.struct(*[F.coalesce(F.bool_or(f"verdict.{f}"), F.lit(False)).alias(f) for f in VERDICT_FIELDS])
    merged = parsed.groupBy(*key).agg(flags.alias("v"), F.bool_or(F.col("verdict").isNull()).alias("unread"))
    illegal = F.col("v.illegal") | F.col("v.sexual_minor") | (F.col("v.minor_present") & (F.col("v.nsfw") | F.col("v.sexual_content")))
    return merged.select(*key, F.when(illegal | ~F.col("unread"), F.col("v")).alias("verdict"))


def output_gate(outputs: DataFrame, verdicts: DataFrame, key: list[str], root: str | None = None) -> DataFrame:
    """Decision per output of a prompt; outputs without a verdict, or outside the store, are destroyed. Split the result
    by ``action = 'keep'`` into gallery rows and audit rows."""
    judged = outputs.join(worst_verdicts(verdicts, key), key, "left").withColumn("d", decide(F.col("verdict"), F.col("nsfw_grant")))
    if root:
        outside = F.struct(F.lit(UNREADABLE).alias("action"), F.lit("outside the store").alias("why"), F.lit("UNPARSEABLE_VERDICT").alias("code"))
        judged = judged.withColumn("d", F.when(F.coalesce(inside_store(F.col("path"), root), F.lit(False)), F.col("d")).otherwise(outside))
    return judged.select(
        *outputs.columns, "d.action", "d.why", "d.code",
        F.coalesce(F.col("verdict.nsfw") | F.col("verdict.sexual_content"), F.lit(False)).alias("nsfw"),
    )


def gate_audit(judged: DataFrame) -> DataFrame:
    """Audit rows of the destroyed outputs, in the shape of text vetoes."""
    named = F.coalesce(category_names(F.array("code"), IMAGE_CATEGORY_NAMES), F.lit(""))
    return judged.where(F.col("action") != KEEP).withColumns({
        "stage": F.lit("image_output"), "reason": F.lit("classifier"),
        "detail": F.concat(named, F.lit(" — "), "why"), "immutable": F.col("action") == ILLEGAL,
    })


# ---- signatures ------------------------------------------------------------------------------

def vector_signature(vector: Column) -> Column:
    """64-bit signature of a 64-value vector as 16 hex digits: bit = value above the median of all
    values but the first (the constant part)."""
    rest = F.array_sort(F.slice(vector, 2, 63))
    bits = let(F.element_at(rest, 32), lambda median: F.array_join(
        F.transform(vector, lambda v: F.when(v > median, "1").otherwise("0")), ""
    ))
    half = [F.lpad(F.lower(F.conv(F.substring(bits, start, 32), 2, 16)), 8, "0") for start in (1, 33)]
    return F.concat(*half)


@F.pandas_udf(StringType())
def _dct_signature(images: pd.Series) -> pd.Series:
    size, low = 32, 8
    wave = np.array([[math.cos((2 * x + 1) * u * math.pi / (2 * size)) for x in range(size)] for u in range(low)])

    def sign(pixels) -> str | None:
        if pixels is None or len(pixels) != size * size:
            return None
        block = (wave @ np.asarray(pixels, dtype=float).reshape(size, size) @ wave.T).ravel()
        median = np.sort(block[1:])[31]
        return f"{int(''.join('1' if v > median else '0' for v in block), 2):016x}"

    return images.map(sign)


def image_signature(pixels: Column) -> Column:
    """Perceptual signature of 32×32 gray values: the low 8×8 block of their cosine transform."""
    return _dct_signature(pixels)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-hex-digit signatures."""
    def word(signature: Column, start: int) -> Column:
        return F.conv(F.substring(signature, start, 8), 16, 10).cast("long")

    return F.bit_count(word(a, 1).bitwiseXOR(word(b, 1))) + F.bit_count(word(a, 9).bitwiseXOR(word(b, 9)))


def _band(signature: Column, i: int, bands: int) -> Column:
    start, end = i * 16 // bands, (i + 1) * 16 // bands
    return F.substring(signature, start + 1, end - start)


def signature_matches(images: DataFrame, holdings: DataFrame, image_key: str, holding_key: str, k: int = 3, bands: int = 8, signature: str = "signature") -> DataFrame:
    """Per image: number of holdings within ``k`` differing bits, and the nearest one.

    Of ``bands`` hex bands at most ``k`` can differ, so two near signatures agree on some
    ``bands - k`` of them: each signature is filed under every such combination (56 for the
    defaults) and matching is an equality join on 40 of the 64 bits, which random signatures
    hardly ever share. Distinct signatures are matched and copies only counted, so neither the
    join nor the result grows with the square of the copies. A pair counts under the first
    combination it agrees on.
    """
    if bands > 16 or k >= bands:
        raise ValueError("need k < bands <= 16")
    agreeing = list(combinations(range(bands), bands - k))
    combos = F.array(*[F.array(*[F.lit(i) for i in combo]) for combo in agreeing])

    def banded(signatures: Column) -> Column:
        return F.array(*[_band(signatures, i, bands) for i in range(bands)])

    def filed(rows: DataFrame, alias: str) -> DataFrame:
        distinct = bind(rows.select(F.col(signature).alias(alias)).distinct(), "cut", banded(F.col(alias)))
        pieces = F.transform(combos, lambda combo: F.array_join(F.transform(combo, lambda i: F.get("cut", i)), ""))
        return distinct.select(alias, F.posexplode(pieces).alias("combo", "piece"))

    # Spark takes a filed side for as small as its signatures and would collect it to broadcast it; it has a row for each combination.
    pairs = filed(images, "ls").join(filed(holdings, "rs").hint("merge"), ["combo", "piece"])
    same = F.transform(banded(F.col("ls")), lambda piece, i: F.when(piece == F.get(banded(F.col("rs")), i), i))
    first = F.array_position(combos, F.slice(F.array_compact(same), 1, bands - k)) - 1
    near = pairs.where(hamming(F.col("ls"), F.col("rs")) <= k).where(F.col("combo") == first).select(
        "ls", "rs", hamming(F.col("ls"), F.col("rs")).alias("distance")
    )
    known = holdings.groupBy(F.col(signature).alias("rs")).agg(F.count(F.lit(1)).alias("copies"), F.min(holding_key).alias("holding"))
    best = near.join(known, "rs").groupBy("ls").agg(
        F.sum("copies").alias("matches"), F.min(F.struct("distance", "holding")).alias("nearest")
    )
    return images.select(image_key, F.col(signature).alias("ls")).join(best, "ls").select(
        image_key, "matches", F.col("nearest.holding").alias("nearest"), F.col("nearest.distance").alias("distance")
    )
