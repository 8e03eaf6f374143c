"""Requests as long tables of turns and texts.

A turn is ``(call_id, idx, role, text)``; order is the explicit ``idx``. Per-request facts are
computed as map-side combined aggregates and joined back, never by gathering a request's rows
into one task, so one very long conversation stays spread over the cluster.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.functions import json_text
from sluiceway.functions.columns import bind, let
from sluiceway.functions.text import base64_fragments, head_tail

# Fixed values.
WINDOW_TURNS = 8
MAX_TURNS = 64
MAX_TURN_CHARS = 32_000
MAX_TOTAL_CHARS = 200_000
NO_USER_TEXT = "(no user text)"
MESSAGES = "array<struct<role:string, content:variant, tool_calls:variant>>"
SYSTEM_IDX = -1

# Order of the parts of a request.
SECTIONS = ("messages", "system", "prompt", "input", "tools", "functions")


def has_text(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def turns(requests: DataFrame) -> DataFrame:
    """Messages of nested requests as turns: content and tool-call text joined, empty turns dropped.

    ``content_text`` is the content alone. Values of any depth and size are read whole.
    """
    messages = F.from_json("messages_json", MESSAGES)
    rows = requests.select("call_id", F.posexplode(messages).alias("idx", "m"))
    flat = rows.select(
        "call_id", "idx", F.coalesce("m.role", F.lit("user")).alias("role"), F.col("m.role").alias("given_role"),
        json_text.content(F.col("m.content")).alias("c"), json_text.tool_calls(F.col("m.tool_calls")).alias("t"),
    )
    both = F.regexp_replace(F.concat_ws("\n", "c", "t"), r"(?U)^\s+|\s+$", "")
    return flat.select(
        "call_id", "idx", "role", "given_role", F.col("c").alias("content_text"),
        F.when(F.col("t").isNotNull(), both).otherwise(F.col("c")).alias("text"),
    )


def _truthy(value: Column) -> Column:
    """Whether a VARIANT is there and neither empty nor zero nor false."""
    return value.isNotNull() & ~F.coalesce(F.to_json(value), F.lit("null")).isin("null", "false", "0", "0.0", '""', "[]", "{}")


def _listed(value: Column) -> Column:
    """The texts of a scalar or of a list: strings as they are, nested elements by their keys and strings."""
    kind = F.schema_of_variant(value)
    items = F.try_variant_get(F.when(kind.startswith("ARRAY"), value), "$", "array<variant>")
    return F.when(_truthy(value), F.coalesce(items, F.array(value)))


def from_bodies(bodies: DataFrame, body: str = "body_json") -> DataFrame:
    """Request bodies given as JSON text, in the columns that ``turns``, ``top_level_texts`` and ``unscannable`` take.

    ``system`` may be a string or a list of parts; ``prompt`` and ``input`` a scalar or a list; ``tools`` and ``functions`` are schemas.
    ``has_payload``: it has a message, a prompt, an input or a system text; schemas alone are none. ``readable`` is false for a body that
    is NULL or no JSON object: such requests are refused, whatever else can be said of them. Messages that are no objects count as none.
    """
    parsed = bind(bodies, "_body", F.try_parse_json(body))
    held = F.col("_body")
    field = {name: F.try_variant_get(held, f"$.{name}", "variant") for name in SECTIONS}
    messages = F.filter(F.try_variant_get(field["messages"], "$", "array<variant>"), lambda m: F.coalesce(F.schema_of_variant(m).startswith("OBJECT"), F.lit(False)))
    listed = {name: _listed(field[name]) for name in ("prompt", "input")}
    payload = (F.coalesce(F.size(messages), F.lit(0)) > 0) | _truthy(field["prompt"]) | _truthy(field["input"]) | _truthy(field["system"])
    return parsed.select(
        *bodies.columns,
        F.when(F.size(messages) > 0, F.to_json(messages)).alias("messages_json"),
        F.when(_truthy(field["system"]), json_text.content(field["system"])).alias("system"),
        *[column.alias(name) for name, column in listed.items()],
        *[F.when(_truthy(field[name]), F.to_json(field[name])).alias(f"{name}_json") for name in ("tools", "functions")],
        payload.alias("has_payload"),
        F.coalesce(F.schema_of_variant(held).startswith("OBJECT"), F.lit(False)).alias("readable"),
    )


def body_texts(parts: DataFrame) -> DataFrame:
    """``(call_id, section, idx, text)`` of all parts of requests from ``from_bodies`` but their messages."""
    def elements(section: str) -> DataFrame:
        rows = parts.select("call_id", F.posexplode(section).alias("idx", "v"))
        plain = F.when(F.schema_of_variant("v").rlike("^(ARRAY|OBJECT)"), json_text.content(F.col("v"))).otherwise(F.try_variant_get("v", "$", "string"))
        return bind(rows.select("call_id", F.lit(section).alias("section"), "idx", "v"), "text", plain).drop("v")

    # Bound: the filter below would be pushed through a projection, and with it a second Arrow step for each text.
    system = bind(parts, "text", F.col("system")).select("call_id", F.lit("system").alias("section"), F.lit(0).alias("idx"), "text")
    texts = [system, elements("prompt"), elements("input")]
    for section in ("tools", "functions"):
        schema = parts.where(F.col(f"{section}_json").isNotNull())
        text = F.array_join(json_text.json_leaves(F.col(f"{section}_json")), "\n")
        texts.append(bind(schema, "text", text).select("call_id", F.lit(section).alias("section"), F.lit(0).alias("idx"), "text"))
    return reduce(DataFrame.unionByName, texts).where(F.col("text").isNotNull())


def pieces(parts: DataFrame) -> DataFrame:
    """``(call_id, section, idx, role, text)`` of all parts of requests from ``from_bodies``: their turns, section ``messages``, and their other texts, without a role."""
    said = turns(parts).select("call_id", F.lit("messages").alias("section"), "idx", "role", "text")
    return said.unionByName(body_texts(parts).withColumn("role", F.lit(None).cast("string")))


def unreadable(requests: DataFrame) -> DataFrame:
    """Requests whose messages or schemas are no readable JSON. They are refused (extraction_failure), never passed."""
    messages = F.col("messages_json").isNotNull() & F.try_parse_json("messages_json").isNull()
    tools = F.col("tools_json").isNotNull() & F.try_parse_json("tools_json").isNull()
    return requests.where(messages | tools)


def top_level_texts(requests: DataFrame) -> DataFrame:
    """``(call_id, section, idx, text)`` of system, prompt, input and tool schemas."""
    def single(section: str, text: Column) -> DataFrame:
        return requests.select("call_id", F.lit(section).alias("section"), F.lit(0).alias("idx"), text.alias("text"))

    def many(section: str) -> DataFrame:
        return requests.select("call_id", F.lit(section).alias("section"), F.posexplode(section).alias("idx", "text"))

    def schemas(section: str, column: str) -> DataFrame:
        found = json_text.json_leaves(F.col(column))
        return requests.where(F.col(column).isNotNull()).select(
            "call_id", F.lit(section).alias("section"), F.lit(0).alias("idx"), F.array_join(found, "\n").alias("text"))

    parts = single("system", F.col("system")).unionByName(many("prompt")).unionByName(many("input"))
    return parts.unionByName(schemas("tools", "tools_json"))


def request_texts(turn_rows: DataFrame, top_level: DataFrame | None = None) -> DataFrame:
    """All scannable texts of requests: originals and the readable texts hidden in them.

    ``text_rank`` orders texts within a request; decoded texts come after all originals.
    """
    rows = turn_rows.select("call_id", F.lit("messages").alias("section"), "idx", "text")
    if top_level is not None:
        rows = rows.unionByName(top_level.select("call_id", "section", "idx", "text"))
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int")
    return with_decoded(rows.where(has_text(F.col("text"))).withColumn("rank", F.struct(order.alias("section"), F.col("idx").alias("idx"))))


def with_decoded(rows: DataFrame) -> DataFrame:
    """Each text plus its decoded fragments, in one pass over the texts."""
    pieces = F.concat(F.array(F.col("text")), base64_fragments(F.col("text")))
    return rows.select(*[c for c in rows.columns if c not in ("text", "rank")], "rank", F.posexplode(pieces).alias("part", "text")).select(
        *[c for c in rows.columns if c not in ("text", "rank")],
        F.when(F.col("part") == 0, "original").otherwise("decoded").alias("origin"),
        F.struct((F.col("part") > 0).alias("decoded"), F.col("rank").alias("at"), F.col("part").alias("part")).alias("text_rank"),
        "text",
    )


def normalise_turns(turn_rows: DataFrame, system: DataFrame | None = None) -> DataFrame:
    """Turns as a two-party conversation: the assistant stays, everyone else is the user; tool
    results are labelled; a top-level system text becomes the first user turn."""
    role = F.when(F.col("role") == "assistant", "assistant").otherwise("user")
    text = F.when(F.col("role") == "tool", F.concat(F.lit("Tool result: "), "text")).otherwise(F.col("text"))
    out = turn_rows.where(F.length("text") > 0).select("call_id", "idx", role.alias("role"), text.alias("text"))
    if system is not None:
        out = out.unionByName(system.where(F.length("text") > 0).select(
            "call_id", F.lit(SYSTEM_IDX).alias("idx"), F.lit("user").alias("role"),
            F.concat(F.lit("System instructions: "), "text").alias("text"),
        ))
    return out


def unscannable(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """Requests with a payload but no text to evaluate. They are refused, never passed.

    The texts are reduced to their distinct calls map-side: an anti join cannot split a hot key on
    its right side.
    """
    return requests.where("has_payload").join(texts.select("call_id").distinct(), "call_id", "left_anti")


def last_user_turn(turn_rows: DataFrame) -> DataFrame:
    """Index (default 0) and text of each request's last user turn with text."""
    is_user = (F.col("role") == "user") & has_text(F.col("text"))
    latest = F.max(F.when(is_user, F.struct("idx", "text")))
    return turn_rows.groupBy("call_id").agg(latest.alias("last")).select(
        "call_id", F.coalesce("last.idx", F.lit(0)).alias("last_idx"), F.coalesce("last.text", F.lit("")).alias("last_text")
    )


def last_user_index(turn_rows: DataFrame) -> DataFrame:
    is_user = (F.col("role") == "user") & has_text(F.col("text"))
    return turn_rows.groupBy("call_id").agg(F.coalesce(F.max(F.when(is_user, F.col("idx"))), F.lit(0)).alias("last_idx"))


def new_segment(turn_rows: DataFrame, top_level: DataFrame | None = None) -> DataFrame:
    """Texts new to the classifier: every turn from the last user turn on, then the system and
    developer texts again (also when already included), then the top-level texts."""
    # Only the index travels through the aggregate and the join, not the texts.
    tail = turn_rows.join(last_user_index(turn_rows), "call_id").where("idx >= last_idx")
    pieces = tail.where(F.length("text") > 0).select("call_id", F.lit("tail").alias("part"), F.lit(0).alias("section"), "idx", "text")
    again = turn_rows.where(F.col("role").isin("system", "developer") & (F.length("text") > 0))
    pieces = pieces.unionByName(again.select("call_id", F.lit("system").alias("part"), F.lit(1).alias("section"), "idx", "text"))
    if top_level is not None:
        order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section")).cast("int")
        pieces = pieces.unionByName(top_level.where(has_text(F.col("text"))).select(
            "call_id", F.lit("top").alias("part"), order.alias("section"), "idx", "text"
        ))
    return pieces


def conversation_window(turn_rows: DataFrame, size: int = 6000, turns_kept: int = WINDOW_TURNS) -> DataFrame:
    """The last turns of each conversation with more than one turn, each cut head and tail.

    Spark limits ranked groups before the shuffle, so each task sends at most ``turns_kept`` rows
    of a conversation, however long it is.
    """
    latest = Window.partitionBy("call_id").orderBy(F.col("idx").desc())
    kept = turn_rows.withColumn("back", F.row_number().over(latest)).where(F.col("back") <= turns_kept)
    # Whether there is a second turn is known from the kept rows alone.
    pair = Window.partitionBy("call_id")
    return (
        kept.withColumn("turns", F.count(F.lit(1)).over(pair)).where("turns > 1")
        .select("call_id", "idx", "role", head_tail(F.col("text"), size).alias("text"))
    )


def chunk_step(size: int, overlap: int) -> int:
    return max(size - overlap, size // 2)


def chunk_starts(length: Column, size: int = 6000, overlap: int = 600) -> Column:
    return F.sequence(F.lit(0), F.greatest(length, F.lit(1)) - 1, F.lit(chunk_step(size, overlap)))


def chunk_parts(text: Column, size: int = 6000, overlap: int = 600) -> Column:
    """The overlapping chunks of a text as an array. The text is read once: it falls into steps, and a chunk is a step and the
    beginning of the next one."""
    step = chunk_step(size, overlap)
    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    return let(steps, lambda own: F.transform(own, lambda s, i: F.concat(s, F.left(F.coalesce(F.get(own, i + 1), F.lit("")), F.lit(size - step)))))


def chunks(rows: DataFrame, text: str = "text", size: int = 6000, overlap: int = 600) -> DataFrame:
    """Overlapping chunks of whole texts, blank ones dropped; ``chunk_idx`` keeps the numbering. A row carries its chunk, not the text."""
    keep = [c for c in rows.columns if c != text]
    cut = rows.select(*keep, F.posexplode(chunk_parts(F.col(text), size, overlap)).alias("chunk_idx", "chunk"))
    return cut.select(*keep, "chunk_idx", (F.col("chunk_idx") * chunk_step(size, overlap)).alias("start"), "chunk").where(has_text(F.col("chunk")))


def chunk_count(length: Column, size: int = 6000, overlap: int = 600) -> Column:
    """Number of chunks before blank ones are dropped."""
    return F.ceil(F.greatest(length, F.lit(1)) / chunk_step(size, overlap)).cast("int")


def admission(turn_rows: DataFrame) -> DataFrame:
    """Size and admissibility of conversations: at most 64 turns of two roles, bounded characters
    after the per-turn cut, ending on a user turn. One map-side combined pass."""
    return turn_rows.groupBy("call_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum(F.least(F.length("text"), F.lit(MAX_TURN_CHARS))).alias("chars"),
        F.bool_and(F.col("role").isin("user", "assistant")).alias("roles_ok"),
        F.max_by("role", "idx").alias("last_role"),
    ).withColumn(
        "admitted",
        F.col("roles_ok") & (F.col("turns") <= MAX_TURNS) & (F.col("chars") <= MAX_TOTAL_CHARS) & (F.col("last_role") == "user"),
    )


def output_context(responses: DataFrame, turn_rows: DataFrame, size: int = 6000) -> DataFrame:
    """Responses with the last user turn of their request as context."""
    context = last_user_turn(turn_rows).select("call_id", head_tail(F.col("last_text"), size).alias("context"))
    filled = F.when(F.coalesce(F.length("context"), F.lit(0)) > 0, F.col("context")).otherwise(F.lit(NO_USER_TEXT))
    return responses.join(context, "call_id", "left").withColumn("context", filled)
