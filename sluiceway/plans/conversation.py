"""Queries over conversations and event payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions import json_text
from sluiceway.functions.columns import bind
from sluiceway.functions.text import normalise
from sluiceway.operators import decisions, json_tree, outputs, requests, tripwires, verdicts
from sluiceway.plans.registry import query
from sluiceway.plans.texts import BLOCKED_SQL, BREAK, RUN, VERDICT_SQL, _PAD, _hits_sql, parsed_verdicts, policy
from sluiceway.session import cut, load, spread

PIECE = 40


def turns(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("idx"), "role", "text"
    )


@query("turns_normalised", """
SELECT conv_id AS call_id, CAST(turn AS INTEGER) AS idx, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role,
  sha256(CASE WHEN role = 'tool' THEN 'Tool result: ' || text ELSE text END) AS digest FROM conversations WHERE length(text) > 0
UNION ALL
SELECT conv_id, -1, 'user', sha256('System instructions: ' || text) FROM conversations WHERE role = 'system' AND turn = 0 AND length(text) > 0""")
def turns_normalised(spark, sf):
    rows = turns(spark, sf)
    system = rows.where("role = 'system' AND idx = 0")
    return requests.normalise_turns(rows, system).select("call_id", "idx", "role", F.sha2("text", 256).alias("digest"))


@query("request_texts", f"""
WITH o AS (SELECT conv_id AS call_id, turn, text FROM conversations WHERE regexp_matches(text, '\\S')),
g AS (SELECT call_id, turn, text, regexp_replace(regexp_replace(regexp_replace(text, '{BREAK}', '\\1\\2', 'g'), '{BREAK}', '\\1\\2', 'g'), '{BREAK}', '\\1\\2', 'g') AS glued FROM o),
r AS (SELECT DISTINCT call_id, turn, unnest(list_concat(regexp_extract_all(text, '{RUN}'), regexp_extract_all(glued, '{RUN}'))) AS run FROM g),
d AS (SELECT call_id, turn, TRY(decode(from_base64({_PAD}))) AS raw FROM r WHERE length(run) % 4 <> 1),
s AS (SELECT DISTINCT call_id, turn, raw, regexp_replace(raw, '[^\\PC\\n\\t\\r]', '', 'g') AS text FROM d WHERE raw IS NOT NULL)
SELECT call_id, CAST(turn AS INTEGER) AS idx, 'original' AS origin, sha256(text) AS digest FROM o
UNION ALL SELECT call_id, CAST(turn AS INTEGER), 'decoded', sha256(text) FROM s WHERE regexp_matches(text, '\\S') AND length(text) * 2 >= length(raw)""")
def request_texts(spark, sf):
    return requests.request_texts(spread(turns(spark, sf))).select("call_id", "idx", "origin", F.sha2("text", 256).alias("digest"))


@query("json_leaves", """
SELECT event_id, array_to_string(list_concat(json_keys(props), list_transform(list_filter(json_keys(props), lambda k: json_type(props, '$.' || k) = 'VARCHAR'),
  lambda k: json_extract_string(props, '$.' || k))), '|') AS leaves FROM events""")
def json_leaves(spark, sf):
    found = json_text.json_leaves(F.col("props"))
    return load(spark, sf, "events").select("event_id", F.array_join(found, "|").alias("leaves"))


# A nested document of each event: its properties as they are, in a list, and inside text-bearing parts.
TREE_SQL = """'{"meta":{"kind":"' || event_type || '","props":' || props || ',"tags":["' || event_type || '",["deep",' || props || '],null,{}]},"parts":[{"type":"text","text":"user ' || user_id || '"},' || event_id || ']}'"""


@query("json_tree_leaves", f"""
WITH d AS (SELECT event_id, CAST({TREE_SQL} AS JSON) AS doc FROM events),
t AS (SELECT event_id, j.fullkey AS path, CASE WHEN NOT ends_with(j.fullkey, ']') THEN j.key END AS name, CASE WHEN j.type = 'VARCHAR' THEN j.atom ->> '$' END AS text
  FROM d, json_tree(d.doc) j WHERE j.fullkey <> '$')
SELECT event_id, path, name, text FROM t WHERE name IS NOT NULL OR text IS NOT NULL""")
def json_tree_leaves(spark, sf):
    documents = load(spark, sf, "events").select("event_id", F.expr(TREE_SQL).alias("doc"))
    return json_tree.members(documents, "event_id", "doc").select("event_id", "path", "name", "text")


@query("unscannable_requests", """
SELECT call_id FROM (SELECT DISTINCT conv_id AS call_id FROM conversations)
WHERE call_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system' AND regexp_matches(text, '\\S'))""")
def unscannable_requests(spark, sf):
    """System turns stand for the parts with text: the fixture has no conversation without any."""
    rows = turns(spark, sf)
    calls = rows.select("call_id").distinct().withColumn("has_payload", F.lit(True))
    texts = rows.where((F.col("role") == "system") & requests.has_text(F.col("text")))
    return requests.unscannable(calls, texts).select("call_id")


LAST_USER_SQL = """
u AS (SELECT conv_id, max(turn) AS last_idx FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\S') GROUP BY conv_id),
w AS (SELECT DISTINCT c.conv_id, coalesce(last_idx, 0) AS last_idx FROM conversations c LEFT JOIN u USING (conv_id))
"""


@query("last_user_turn", f"""WITH {LAST_USER_SQL}
SELECT w.conv_id AS call_id, CAST(w.last_idx AS INTEGER) AS last_idx, sha256(coalesce(c.text, '')) AS digest
FROM w LEFT JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.last_idx AND c.role = 'user'""")
def last_user_turn(spark, sf):
    return requests.last_user_turn(turns(spark, sf)).select("call_id", "last_idx", F.sha2("last_text", 256).alias("digest"))


@query("new_segment", f"""WITH {LAST_USER_SQL}
SELECT conv_id AS call_id, CAST(turn AS INTEGER) AS idx, 'tail' AS part, sha256(text) AS digest FROM conversations JOIN w USING (conv_id) WHERE turn >= last_idx AND length(text) > 0
UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 'system', sha256(text) FROM conversations WHERE role IN ('system', 'developer') AND length(text) > 0""")
def new_segment(spark, sf):
    return requests.new_segment(turns(spark, sf)).select("call_id", "idx", "part", F.sha2("text", 256).alias("digest"))


def _cut_sql(size: int) -> str:
    return f"CASE WHEN length(text) <= {size} THEN text ELSE substr(text, 1, {size // 2}) || chr(10) || '…' || chr(10) || right(text, {size // 2}) END"


@query("conversation_window", f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id AS call_id, CAST(turn AS INTEGER) AS idx, CASE WHEN role = 'assistant' THEN role ELSE 'user' END AS role, sha256({_cut_sql(600)}) AS digest
FROM r WHERE back <= 8 AND n > 1""")
def conversation_window(spark, sf):
    window = requests.conversation_window(requests.normalise_turns(turns(spark, sf)), size=600)
    return window.select("call_id", "idx", "role", F.sha2("text", 256).alias("digest"))


@query("conversation_admission", """
SELECT conv_id AS call_id, count(*) AS turns, CAST(sum(least(length(text), 32000)) AS BIGINT) AS chars, bool_and(role IN ('user', 'assistant')) AS roles_ok,
  arg_max(role, turn) AS last_role, bool_and(role IN ('user', 'assistant')) AND count(*) <= 64 AND sum(least(length(text), 32000)) <= 200000 AND arg_max(role, turn) = 'user' AS admitted
FROM conversations GROUP BY conv_id""")
def conversation_admission(spark, sf):
    return requests.admission(turns(spark, sf))


@query("output_context", f"""
SELECT a.conv_id AS call_id, CAST(a.turn AS INTEGER) AS idx, sha256(a.text) AS output, sha256(coalesce({_cut_sql(600).replace('text', 'u.text')}, '(no user text)')) AS context
FROM (SELECT * FROM conversations WHERE role = 'assistant') a
ASOF LEFT JOIN (SELECT * FROM conversations WHERE role = 'user' AND regexp_matches(text, '\\S')) u ON u.conv_id = a.conv_id AND u.turn < a.turn""")
def output_context(spark, sf):
    """Every answer, and the user turn it answers."""
    rows = turns(spark, sf)
    call = F.struct("call_id", F.col("at").alias("idx"))
    answers = rows.where("role = 'assistant'").select("call_id", F.col("idx").alias("at"), F.col("text").alias("output"))
    before = rows.join(answers.select("call_id", "at"), "call_id").where("idx < at").withColumn("call_id", call)
    responses = answers.select(call.alias("call_id"), "output")
    return requests.output_context(responses, before, size=600).select(
        "call_id.call_id", "call_id.idx", F.sha2("output", 256).alias("output"), F.sha2("context", 256).alias("context")
    )


def stream_pieces(rows: DataFrame) -> DataFrame:
    """Assistant turns as streamed pieces of a few characters: ``choice`` is the turn."""
    at = F.posexplode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))).alias("seq", "start")
    return rows.where("role = 'assistant'").select("call_id", F.col("idx").alias("choice"), "text", at).select(
        "call_id", "choice", F.col("seq").cast("long").alias("seq"), F.substring(F.col("text"), F.col("start"), F.lit(PIECE)).alias("piece")
    )


@query("stream_assemble", f"""
SELECT conv_id AS call_id, CAST(turn AS INTEGER) AS choice, sha256(text) AS digest, CAST(greatest(ceil(length(text) / {PIECE}.0), 1) AS INTEGER) AS pieces
FROM conversations WHERE role = 'assistant'""")
def stream_assemble(spark, sf):
    pieces = stream_pieces(turns(spark, sf))
    return outputs.assemble(pieces, ["call_id", "choice"], "seq").select("call_id", "choice", F.sha2("text", 256).alias("digest"), "pieces")


@query("segment_chunks", f"""
WITH {LAST_USER_SQL},
p AS (SELECT conv_id, 0 AS section, turn, text FROM conversations JOIN w USING (conv_id) WHERE turn >= last_idx AND length(text) > 0
  UNION ALL SELECT conv_id, 1, turn, text FROM conversations WHERE role IN ('system', 'developer') AND length(text) > 0),
r AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY section, turn) AS text FROM p GROUP BY conv_id),
s AS (SELECT conv_id, text, unnest(range(0, greatest(length(text), 1), 5400)) AS start FROM r)
SELECT conv_id AS call_id, CAST(start / 5400 AS INTEGER) AS chunk_idx, sha256(substr(text, start + 1, 6000)) AS digest FROM s WHERE regexp_matches(substr(text, start + 1, 6000), '\\S')""")
def segment_chunks(spark, sf):
    """Classifier chunks of what is new in each conversation."""
    segment = requests.new_segment(turns(spark, sf))
    at = F.col("section").cast("long") * 2**40 + F.col("idx")
    chunks = outputs.assembled_chunks(segment.select("call_id", at.alias("at"), "text"), "call_id", "at", "text")
    return chunks.select("call_id", "chunk_idx", F.sha2("chunk", 256).alias("digest"))


CALL_CHUNKS = 1  # classifier calls allowed in the query below, so that the fixture has requests over it


@query("request_decision", f"""
WITH {_hits_sql(tripwires.REQUEST_LISTS, "(SELECT conv_id * 1000 + turn AS msg, text FROM conversations)", "msg")}, {VERDICT_SQL}, {LAST_USER_SQL},
calls AS (SELECT conv_id, bool_or(regexp_matches(text, '\\S')) AS has_text FROM conversations GROUP BY conv_id),
firsts AS (SELECT msg // 1000 AS conv_id, list FROM hits QUALIFY row_number() OVER (PARTITION BY msg // 1000 ORDER BY list_rank, msg, pattern_rank) = 1),
p AS (SELECT conv_id, text FROM conversations JOIN w USING (conv_id) WHERE turn >= last_idx AND length(text) > 0
  UNION ALL SELECT conv_id, text FROM conversations WHERE role IN ('system', 'developer') AND length(text) > 0),
long AS (SELECT conv_id, ceil(greatest(sum(length(text) + 1) - 1, 1) / 5400) > {CALL_CHUNKS} AS too_long FROM p GROUP BY conv_id),
j AS (SELECT c.conv_id, has_text, list, too_long, raw, regexp_extract(raw, 'S\\d+') AS code
  FROM calls c LEFT JOIN firsts USING (conv_id) LEFT JOIN long USING (conv_id) LEFT JOIN raw ON raw.doc_id = c.conv_id),
d AS (SELECT conv_id, CASE WHEN NOT has_text THEN 'no_scannable_text' WHEN list IS NOT NULL THEN 'regex:' || list WHEN too_long THEN 'prompt_too_long_for_guard'
  WHEN raw IS NULL THEN 'guard_unavailable' WHEN code IN {BLOCKED_SQL} THEN 'classifier' ELSE 'pass' END AS reason FROM j)
SELECT conv_id AS call_id, reason, CAST(CASE reason WHEN 'pass' THEN 200 WHEN 'prompt_too_long_for_guard' THEN 413 WHEN 'guard_unavailable' THEN 503 ELSE 400 END AS INTEGER) AS status FROM d""")
def request_decision(spark, sf):
    """One decision per conversation, its label standing in for the classifier's answer."""
    rows = turns(spark, sf)
    texts = bind(requests.request_texts(rows).select("call_id", "text_rank", "text"), "norm", normalise(F.col("text")))
    hits = tripwires.first_hit(tripwires.scan(texts, "norm", tripwires.REQUEST_LISTS, policy().extra_patterns), "call_id", "text_rank")
    new = requests.new_segment(rows).groupBy("call_id").agg((F.sum(F.length("text") + 1) - 1).alias("chars"))
    answers = parsed_verdicts(spark, sf).select(F.col("doc_id").alias("call_id"), F.lit(0).alias("chunk_idx"), "v")
    judged = verdicts.request_verdict(answers, "call_id", "chunk_idx", "v", policy())
    calls = rows.select("call_id").distinct().withColumn("has_payload", F.lit(True))
    out = decisions.decide_requests(calls, "call_id", texts, hits, new, judged, max_chunks=CALL_CHUNKS)
    return out.select("call_id", F.coalesce("reason", F.lit("pass")).alias("reason"), "status")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation as a request body, in one of six shapes: messages; system parts and a list of inputs; one prompt; an image
    alone; function schemas alone; broken JSON."""
    said = F.sort_array(F.collect_list(F.struct("idx", "role", F.coalesce("text", F.lit("")).alias("text"))))
    calls = turns(spark, sf).groupBy("call_id").agg(said.alias("t"))

    def of(role: str, part) -> "F.Column":
        return F.transform(F.filter("t", lambda x: x["role"] == role), part)

    text = lambda x: x["text"]
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    system = of("system", lambda x: F.struct(F.lit("text").alias("type"), x["text"].alias("text")))
    image = F.lit('{"messages":[{"role":"user","content":[{"type":"image_url","image_url":{"url":"data:,"}}]}]}')
    schema = F.array(F.struct(F.lit("note").alias("name"), F.col("t")[0]["text"].alias("description")))
    shapes = [
        F.to_json(F.struct(messages.alias("messages"))), F.to_json(F.struct(system.alias("system"), of("user", text).alias("input"))),
        F.to_json(F.struct(F.try_element_at(of("user", text), F.lit(-1)).alias("prompt"))), image, F.to_json(F.struct(schema.alias("functions"))),
        F.lit('{"messages":['),
    ]
    return calls.select("call_id", F.get(F.array(*shapes), (F.col("call_id") % len(shapes)).cast("int")).alias("body_json"))


PARTS_SQL = """
m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, conv_id % 6 AS shape, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
  row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS nth, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS back FROM conversations),
parts AS (SELECT conv_id, 'messages' AS section, place AS idx, text FROM m WHERE shape = 0
  UNION ALL SELECT conv_id, 'system', 0, string_agg(text, chr(10) ORDER BY turn) FROM m WHERE shape = 1 AND role = 'system' AND text <> '' GROUP BY conv_id
  UNION ALL SELECT conv_id, 'input', nth, text FROM m WHERE shape = 1 AND role = 'user'
  UNION ALL SELECT conv_id, 'prompt', 0, text FROM m WHERE shape = 2 AND role = 'user' AND back = 1
  UNION ALL SELECT conv_id, 'functions', 0, 'description' || chr(10) || 'name' || chr(10) || text || chr(10) || 'note' FROM m WHERE shape = 4 AND place = 0)
"""


def parts_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(requests in parts, pieces of all of them). Both are stored: every later step reads them, and would parse the bodies anew, each time through Python workers
    of its own. A task has one of these at a time, for nested values here or for foreign letters later."""
    parts = cut(requests.from_bodies(bodies(spark, sf)).drop("body_json"))
    return parts, cut(requests.pieces(parts))


@query("request_parts", f"""WITH {PARTS_SQL}
SELECT conv_id AS call_id, section, CAST(idx AS INTEGER) AS idx, sha256(text) AS digest FROM parts WHERE regexp_matches(text, '\\S')""")
def request_parts(spark, sf):
    _, rows = parts_of(spark, sf)
    return rows.where(requests.has_text(F.col("text"))).select("call_id", "section", "idx", F.sha2("text", 256).alias("digest"))


@query("request_payloads", f"""
WITH {PARTS_SQL}, {_hits_sql(tripwires.REQUEST_LISTS, "(SELECT conv_id, text FROM parts)", "conv_id")}, {VERDICT_SQL},
calls AS (SELECT conv_id, conv_id % 6 AS shape, CASE conv_id % 6 WHEN 0 THEN true WHEN 1 THEN bool_or(role IN ('system', 'user')) WHEN 2 THEN bool_or(role = 'user' AND back = 1 AND text <> '')
  WHEN 3 THEN true ELSE false END AS has_payload FROM m GROUP BY conv_id),
texts AS (SELECT DISTINCT conv_id, true AS has_text FROM parts WHERE regexp_matches(text, '\\S')),
firsts AS (SELECT conv_id, arg_min(list, list_rank) AS list FROM hits GROUP BY conv_id),
j AS (SELECT c.*, coalesce(has_text, false) AS has_text, list, raw, regexp_extract(raw, 'S\\d+') AS code
  FROM calls c LEFT JOIN texts USING (conv_id) LEFT JOIN firsts USING (conv_id) LEFT JOIN raw ON raw.doc_id = c.conv_id)
SELECT conv_id AS call_id, has_payload, shape <> 5 AS readable, CASE WHEN shape = 5 THEN 'extraction_failure' WHEN NOT has_text AND has_payload THEN 'no_scannable_text' WHEN NOT has_text THEN 'pass'
  WHEN list IS NOT NULL THEN 'regex:' || list WHEN raw IS NULL THEN 'guard_unavailable' WHEN code IN {BLOCKED_SQL} THEN 'classifier' ELSE 'pass' END AS reason FROM j""")
def request_payloads(spark, sf):
    """Whole request bodies to decisions: what they hold, whether they can be read, and the first reason to refuse them."""
    parts, held = parts_of(spark, sf)
    rows, others = held.where("section = 'messages'"), held.where("section <> 'messages'")
    texts = requests.request_texts(rows, others)
    norms = bind(texts.select("call_id", "text_rank", "text"), "norm", normalise(F.col("text")))
    hits = tripwires.first_hit(tripwires.scan(norms, "norm", tripwires.REQUEST_LISTS, policy().extra_patterns), "call_id", "text_rank")
    new = requests.new_segment(rows, others).groupBy("call_id").agg((F.sum(F.length("text") + 1) - 1).alias("chars"))
    answers = parsed_verdicts(spark, sf).select(F.col("doc_id").alias("call_id"), F.lit(0).alias("chunk_idx"), "v")
    judged = verdicts.request_verdict(answers, "call_id", "chunk_idx", "v", policy())
    out = decisions.decide_requests(parts, "call_id", texts, hits, new, judged, unreadable=parts.where("NOT readable"))
    return parts.select("call_id", "has_payload", "readable").join(out.select("call_id", F.coalesce("reason", F.lit("pass")).alias("reason")), "call_id")


@query("response_texts", """
SELECT conv_id AS call_id, CAST(turn AS INTEGER) AS choice, 0 AS field, sha256(text) AS digest FROM conversations WHERE length(text) > 0 AND role = 'assistant'
UNION ALL SELECT conv_id, CAST(turn AS INTEGER), 5, sha256('note ' || role) FROM conversations WHERE role = 'assistant'""")
def response_texts(spark, sf):
    """Texts of responses with one choice and one tool call each, built from assistant turns."""
    call = F.struct(F.struct(F.lit("note").alias("name"), F.to_json(F.array("role")).alias("arguments")).alias("function"))
    choice = F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls")).alias("message"))
    rows = turns(spark, sf).where("role = 'assistant'")
    responses = rows.select(F.struct("call_id", "idx").alias("call_id"), F.to_json(F.array(choice)).alias("choices_json"))
    return outputs.response_texts(responses).select("call_id.call_id", F.col("call_id.idx").alias("choice"), "field", F.sha2("text", 256).alias("digest"))


OUTPUT_CHARS = 1500  # cap on a response in the query below, so that the fixture has responses over it


@query("output_decision", f"""
WITH {_hits_sql(tripwires.OUTPUT_LISTS, "(SELECT conv_id * 1000 + turn AS msg, text FROM conversations WHERE role = 'assistant')", "msg")}, {VERDICT_SQL},
j AS (SELECT conv_id * 1000 + turn AS call_id, length(c.text) AS n, regexp_matches(c.text, '\\S') AS has_text, list, raw, regexp_extract(raw, 'S\\d+') AS s
  FROM conversations c LEFT JOIN hits ON msg = conv_id * 1000 + turn LEFT JOIN raw ON raw.doc_id = conv_id WHERE role = 'assistant'),
d AS (SELECT call_id, s, CASE WHEN n > {OUTPUT_CHARS} THEN 'output_buffer_cap' WHEN call_id % 7 = 3 THEN 'extraction_failure' WHEN NOT has_text THEN 'pass'
  WHEN list IS NOT NULL THEN 'regex:' || list WHEN raw IS NULL THEN 'guard_unavailable' WHEN s IN {BLOCKED_SQL} THEN 'classifier' ELSE 'pass' END AS reason FROM j)
SELECT call_id, reason, CAST(CASE reason WHEN 'pass' THEN 200 WHEN 'extraction_failure' THEN 500 WHEN 'guard_unavailable' THEN 503 ELSE 400 END AS INTEGER) AS status,
  CASE WHEN reason = 'classifier' THEN s ELSE '' END AS codes FROM d""")
def output_decision(spark, sf):
    """One decision per answer: nested responses, every seventh of them cut off, with the label of the conversation as the
    classifier's answer and the streamed pieces for the size caps."""
    said = turns(spark, sf).where("role = 'assistant'").withColumn("conv", F.col("call_id")).withColumn("call_id", F.col("conv") * 1000 + F.col("idx"))
    document = F.to_json(F.array(F.struct(F.lit(0).alias("index"), F.struct(F.col("text").alias("content")).alias("message"))))
    cut_off = F.when(F.col("call_id") % 7 == 3, F.substring(document, F.lit(1), F.length(document) - 1)).otherwise(document)
    responses = said.select("call_id", cut_off.alias("choices_json"))
    texts = requests.with_decoded(outputs.response_texts(responses).withColumn("rank", F.struct("choice", "field")))
    norm = bind(texts.where(requests.has_text(F.col("text"))), "norm", normalise(F.col("text")))
    hits = tripwires.first_hit(tripwires.scan(norm, "norm", tripwires.OUTPUT_LISTS, policy().extra_patterns), "call_id", "text_rank")
    over = outputs.over_caps(stream_pieces(said), max_chars=OUTPUT_CHARS)
    answers = parsed_verdicts(spark, sf).select(F.col("doc_id").alias("conv"), F.lit(0).alias("chunk_idx"), "v").join(said.select("conv", "call_id"), "conv")
    judged = verdicts.request_verdict(answers, "call_id", "chunk_idx", "v", policy())
    out = decisions.decide_outputs(responses, "call_id", texts, hits, judged, over, outputs.unreadable(responses))
    return out.select("call_id", F.coalesce("reason", F.lit("pass")).alias("reason"), "status", F.array_join(F.coalesce("codes", F.array().cast("array<string>")), ",").alias("codes"))
