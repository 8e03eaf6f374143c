"""Stateful streams: the buffer-and-release gate."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluiceway.functions.columns import bind
from sluiceway.functions.json_text import spoken_arguments
from sluiceway.operators import requests, tripwires
from sluiceway.operators.outputs import MAX_OUTPUT_CHARS, MAX_OUTPUT_CHUNKS
from sluiceway.policy import Policy
from sluiceway.streaming.jobs import scan_texts

WITHHELD_TEXT = "[Response withheld by policy: veto_triggered]"
HOLD_MS = 600_000
MARK_MS = 24 * 3_600_000  # how long a call that was passed on is remembered

OUTPUTS = "array<struct<choice:int, kind:string, text:string>>"
BUFFERED = f"call_id STRING, reason STRING, chunks BIGINT, chars BIGINT, ended_at TIMESTAMP, outputs {OUTPUTS}"
PACKED = f"call_id STRING, reason STRING, chunks BIGINT, chars BIGINT, ended_us BIGINT, outputs {OUTPUTS}"
CHUNK_FIELDS = ("seq", "choice", "content", "reasoning", "tool_idx", "tool_name", "tool_args", "finished", "choices", "at")
HELD_STATE = "pieces STRING, ends STRING, chunks BIGINT, chars BIGINT, ended_us BIGINT, done BOOLEAN"
RELEASED = "call_id STRING, choice INT, kind STRING, text STRING, finish_reason STRING, reason STRING"


def _assemble(pieces: list) -> list[dict]:
    """Held pieces ``[seq, choice, kind, tool, text]`` as one text per choice and kind."""
    joined: dict[tuple, str] = {}
    for _, choice, kind, tool, text in sorted(pieces):
        slot = (choice, kind, tool)
        # A tool's name is sent once; its arguments come in parts.
        joined[slot] = joined.get(slot) or text if kind == "name" else joined.get(slot, "") + text
    out = []
    for (choice, kind, tool), text in sorted(joined.items()):
        if kind in ("content", "reasoning"):
            out.append({"choice": choice, "kind": kind, "text": text})
        elif kind == "args" or (choice, "args", tool) not in joined:
            name = joined.get((choice, "name", tool), "")
            spoken = spoken_arguments(text) if kind == "args" else ""
            out.append({"choice": choice, "kind": "tool", "text": f"{name} {spoken}"})
    return out


def _complete(seen: set[int], ends: dict[int, int], choices: int) -> bool:
    """Whether every choice has ended and no chunk before the last end is missing. Chunks of a call count from 0."""
    return len(ends) >= choices and seen >= set(range(max(ends.values(), default=0) + 1))


def _step(call_id: str, chunk_rows: Iterable[dict], state: GroupState, hold_ms: int | None, mark_ms: int = MARK_MS) -> dict | None:
    """Hold a call's chunks until all its choices are complete or it breaks a cap; give it back once. A chunk's ``at`` is in microseconds.

    Past the caps the call is withheld by rule, so its text need not be kept. A call that was emitted, also by time-out, leaves a mark for
    ``mark_ms``, and chunks that come later are swallowed: they cannot start the call anew. Each of them renews the mark.
    """
    held, ended, chunks, chars, ended_us, done = state.get if state.exists else ("[]", "[0, [], {}]", 0, 0, -1, False)

    def call(reason: str | None, outputs: list[dict]) -> dict:
        return {"call_id": call_id, "reason": reason, "chunks": chunks, "chars": chars, "ended_us": None if ended_us < 0 else ended_us, "outputs": outputs}

    pieces = json.loads(held)
    choices, seen, ends = json.loads(ended)
    seen, ends = set(seen), {int(c): at for c, at in ends.items()}
    reason = emitted = None
    if state.hasTimedOut:
        if done:
            state.remove()
            return None
        state.update(("[]", "[0, [], {}]", chunks, chars, ended_us, True))
        state.setTimeoutDuration(mark_ms)
        return call("stream_timeout", [])
    for row in chunk_rows:
        seq = int(row["seq"])
        if done or seq in seen:
            continue
        chunks += 1
        seen.add(seq)
        if row.get("at") is not None:
            ended_us = max(ended_us, row["at"])
        tool, choice, expected = (default if row.get(f) is None else int(row[f]) for f, default in (("tool_idx", -1), ("choice", 0), ("choices", 1)))
        choices = max(choices, choice + 1, expected)
        if row.get("finished"):
            ends[choice] = seq
        if reason:
            continue
        for kind, field in (("content", "content"), ("reasoning", "reasoning"), ("name", "tool_name"), ("args", "tool_args")):
            text = row.get(field)
            if text:
                pieces.append([seq, choice, kind, tool if kind in ("name", "args") else -1, text])
                chars += len(text) if kind != "name" else 0
        if chars > MAX_OUTPUT_CHARS or chunks > MAX_OUTPUT_CHUNKS:
            reason, pieces = "output_buffer_cap", []
    if not done and (reason or _complete(seen, ends, choices)):
        outputs = []
        if reason is None:
            outputs = _assemble(pieces)
            if not any(o["text"].strip() for o in outputs):
                reason = "no_scannable_output"
        emitted = call(reason, outputs)
        done, pieces, seen, ends = True, [], set(), {}
    state.update((json.dumps(pieces), json.dumps([choices, sorted(seen), ends]), chunks, chars, ended_us, done))
    if hold_ms:
        state.setTimeoutDuration(mark_ms if done else hold_ms)
    return emitted


def _hold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, hold_ms: int | None, mark_ms: int = MARK_MS) -> Iterator[pd.DataFrame]:
    """``_step`` on frames with a column for each field of a chunk."""
    rows = ({f: v for f, v in row.items() if not pd.isna(v)} for batch in batches for row in batch.to_dict("records"))
    emitted = _step(key[0], rows, state, hold_ms, mark_ms)
    if emitted:
        yield pd.DataFrame([emitted])


def buffer_calls(chunks: DataFrame, hold_ms: int | None = HOLD_MS) -> DataFrame:
    """Streamed chunks as complete calls. Nothing of a call is passed on before it is complete. ``ended_at`` is the latest time
    (``at``, where chunks have it) of the call's chunks.

    A call that does not finish within ``hold_ms`` is withheld. Spark keeps running empty batches to
    look for such calls, so a run that should end by itself (``availableNow``) passes None: its
    unfinished calls stay in the state, unreleased, until the next run.
    """
    # Spark makes a frame of every call's rows and one of what comes back, and a column of such small frames costs more than the rows
    # in it. So a chunk is one string, and so is a call.
    fields = [F.unix_micros("at").alias("at") if f == "at" else F.col(f) for f in CHUNK_FIELDS if f in chunks.columns]
    packed = chunks.select("call_id", F.to_json(F.struct(*fields)).alias("chunk"))

    def hold(key, batches, state):
        emitted = _step(key[0], (json.loads(chunk) for batch in batches for chunk in batch["chunk"]), state, hold_ms)
        if emitted:
            yield pd.DataFrame({"call": [json.dumps(emitted)]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if hold_ms else GroupStateTimeout.NoTimeout
    calls = packed.groupBy("call_id").applyInPandasWithState(hold, "call STRING", HELD_STATE, "append", timeout)
    read = bind(calls, "c", F.from_json("call", PACKED, {"mode": "FAILFAST"}))
    return read.select("c.call_id", "c.reason", "c.chunks", "c.chars", F.timestamp_micros("c.ended_us").alias("ended_at"), "c.outputs")


def release(calls: DataFrame, policy: Policy) -> DataFrame:
    """Released texts of calls that pass the output tripwires, one withheld marker for the others.

    Where calls come with ``verdict``, the reason for which the classifier holds a call back, it counts after the tripwires.
    """
    texts = calls.where("reason IS NULL").select("call_id", F.inline("outputs"))
    ranked = requests.with_decoded(texts.where(requests.has_text(F.col("text"))).withColumn("rank", F.lit(0)))
    hits = scan_texts(ranked.select("call_id", "text"), policy, tripwires.OUTPUT_LISTS)
    vetoed = hits.groupBy("call_id").agg(F.min("reason").alias("veto"))
    marker = F.col("reason").isNotNull()
    verdict = ["verdict"] if "verdict" in calls.columns else []
    judged = calls.join(vetoed, "call_id", "left").withColumn("reason", F.coalesce("reason", "veto", *verdict))
    withheld = F.array(F.struct(F.lit(0).alias("choice"), F.lit("content").alias("kind"), F.lit(WITHHELD_TEXT).alias("text")))
    # One branch for both kinds: two would scan the texts twice.
    texts = F.when(marker, withheld).otherwise(F.col("outputs"))
    return judged.select("call_id", "reason", F.inline(texts)).select(
        "call_id", "choice", "kind", "text", F.when(marker, F.lit("content_filter")).otherwise(F.lit("stop")).alias("finish_reason"), "reason"
    )
