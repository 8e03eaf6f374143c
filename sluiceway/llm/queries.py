"""The operators over the shared tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import chat_template, cover_repeats, curriculum_mix, dual_tree_rank, filter_audit, lattice_lm, line_align, matrix_bpe, pseudonyms, quality_cascade, simhash_trie, tiled_topk, trie_counts
from sluiceway.functions.columns import bind
from sluiceway.session import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BYTE_BPE = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
PSEUDONYM_KEY = "a key for the shared tables"  # production keys come from the caller
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


@query("op1_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
spread AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS pos FROM d WHERE len(w) >= 3),
windows AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w[pos], w[pos + 1], w[pos + 2]) AS n FROM spread),
repeats AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM windows, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
line_sums AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dups,
    count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•]')) AS bullets,
    count(*) FILTER (regexp_matches(line, '(\.\.\.|…)[\x20\x09-\x0D]*$')) AS fading
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.dups, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(l.n, 0) AS n_lines,
    coalesce(l.bullets, 0) AS bullets, coalesce(l.fading, 0) AS fading,
    length(text) - length(replace(text, '!', '')) AS shouts,
    len([x FOR x IN w IF regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')]) AS capitals
  FROM d LEFT JOIN repeats r USING (doc_id) LEFT JOIN line_sums l USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 100 * n_words OR 10 * capitals > 3 * n_words OR 10 * bullets > 9 * n_lines
    OR 10 * fading > 3 * n_lines OR 5 * n_dup_lines > 2 * n_lines OR 10 * shouts > 3 * n_words OR 10 * n_symbols > n_words) AS kept
FROM b
""")
def op1_quality_rules(spark, sf):
    judged = quality_cascade.judge(load(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op4_pseudonyms")
def op4_pseudonyms(spark, sf):
    done = pseudonyms.pseudonymise(load(spark, sf, "documents").select("doc_id", "text"), PSEUDONYM_KEY)
    return done.select("doc_id", "text", F.size("spans").cast("long").alias("n_spans"), F.array_join("spans.kind", ",").alias("kinds"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    outputs = ("n_tokens", "ids_sha256", "decoded_sha256")
    encoded = matrix_bpe.encode(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN, outputs=outputs)
    return encoded.select("doc_id", *outputs)


@query("op9_simhash")
def op9_simhash(spark, sf):
    grouped = simhash_trie.groups(load(spark, sf, "documents").select("doc_id", "text"))
    return grouped.select("doc_id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), "component_id")


@query("op2_line_dedup")
def op2_line_dedup(spark, sf):
    left = line_align.dedup(load(spark, sf, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_words", "deleted_lines", "deleted_words", "n_partners", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op3_curriculum_mix", rf"""
WITH d AS (SELECT doc_id, source, len({WORDS_SQL}) AS size, CAST(doc_id AS VARCHAR) AS k FROM documents),
n AS (SELECT count(*) AS n, greatest(2000, CAST(floor(sqrt(count(*))) AS BIGINT)) AS per FROM d),
b AS (SELECT d.*, CAST(('0x' || substr(md5(k), 1, 8)) AS BIGINT) % greatest(1, (n.n + n.per - 1) // n.per) AS bucket FROM d, n),
s AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, ([5, 2, 1])[r % 3 + 1] AS weight, 3 * source_size AS cap FROM s),
v AS (SELECT *, sum(source_size) OVER () AS total,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
      / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT *, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target,
    ([1.5, 1.0, 0.5])[r % 3 + 1]::DOUBLE AS w0, ([-1.0, 0.0, 1.0])[r % 3 + 1]::DOUBLE AS slope FROM v),
p AS (SELECT unnest([0, 1, 2]) AS pass),
c AS (SELECT b.*, t.source_size, t.target, t.total, t.w0, t.slope, p.pass,
    p.pass * t.source_size + coalesce(sum(b.size) OVER (PARTITION BY b.source, p.pass
      ORDER BY md5(p.pass || ':' || b.bucket), md5(p.pass || ':' || b.k), b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source CROSS JOIN p),
k AS (SELECT *, greatest(0, least(size, CAST(floor(target + 0.5) AS BIGINT) - pos)) AS take, pos / target AS y FROM c)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(sum(take) AS BIGINT) AS taken,
  CAST(floor(min(CASE WHEN take > 0 THEN total * (0.0 + 2.0 * y / (w0 + sqrt(w0 * w0 + 2.0 * slope * y))) END)) AS BIGINT) AS first_position
FROM k GROUP BY doc_id, size, source_size, target
""")
def op3_curriculum_mix(spark, sf):
    planned = curriculum_mix.plan(load(spark, sf, "documents").select("doc_id", "text", "source"))
    first = F.array_min(F.transform("copies", lambda c: c["position"]))
    return planned.select("doc_id", "size", "source_size", "target", "taken", F.floor(first).alias("first_position"))


@query("op6_lattice_lm")
def op6_lattice_lm(spark, sf):
    held = lambda: F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    scored = lattice_lm.score(load(spark, sf, "documents").select("doc_id", "text"), ~held(), public_tokenizers.path(PIECES))
    return scored.select("doc_id", (~F.col("learns")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op7_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
""")
def op7_exact_topk(spark, sf):
    return tiled_topk.search(load(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_token_counts")
def op8_token_counts(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return trie_counts.count_tokens(docs, public_tokenizers.path(PIECES)).select("doc_id", "n_tokens")


@query("op10_chat_format", rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(text) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(text, '<s>|</s>|\[SYS\]|\[/SYS\]|\[INST\]|\[/INST\]|\[OUT\]|\[ROLE\]|\[/ROLE\]|\[/TURN\]')) AS escaped,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10 ELSE 24 + length(role) END AS marks FROM c),
m AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, '') || '>' || role NOT IN
    ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AS refused FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(escaped + marks) AS BIGINT) AS formatted_chars,
  NOT bool_or(refused) AND arg_max(role, pos) = 'assistant' AS valid, min(pos) FILTER (refused) AS first_refused
FROM m GROUP BY conv_id
""")
def op10_chat_format(spark, sf):
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    done = chat_template.format_conversations(turns)
    done = bind(done, "out", F.struct(chat_template.rendered(F.col("segments")).alias("formatted"), chat_template.loss_spans(F.col("segments")).alias("spans")))
    back = done.select("conv_id", "valid", "first_refused", F.length("out.formatted").cast("long").alias("formatted_chars"),
                       F.explode(F.array(F.struct(chat_template.read_turns(F.col("out.formatted")).alias("turns"),
                                                  chat_template.read_loss(F.col("out.formatted"), F.col("out.spans")).alias("loss")))).alias("back"))
    told = F.array_join(F.transform("back.turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select("conv_id", F.size("back.turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("back.loss").cast("long").alias("loss_chars"), F.sha2("back.loss", 256).alias("loss_sha256"), "formatted_chars", "valid", "first_refused")


@query("op11_dual_tree_rank", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM benchmark),
c AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(c.n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(w) * c.n) // c.l AS m FROM d, c),
s AS (SELECT i.item_id, m.doc_id, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score
  FROM i JOIN t USING (term) JOIN f USING (term) JOIN m USING (r) GROUP BY i.item_id, m.r, m.doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
""")
def op11_dual_tree_rank(spark, sf):
    return dual_tree_rank.rank(load(spark, sf, "documents"), load(spark, sf, "benchmark"))


@query("op12_filter_audit", r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS least, part, text, w FROM w),
m AS (SELECT doc_id, part, (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 4 ELSE 0 END)
    + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 1 ELSE 0 END AS good,
    CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN 1 ELSE 0 END AS toxic FROM l),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
    list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k, 1)) - 65))) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, bit, CAST(coalesce(sum(n) FILTER (mask & (coalesce(before, 0) | bit)::BIGINT = 0), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT > 0), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (mask & bit > 0 AND mask & coalesce(before, 0)::BIGINT = 0), 0) AS BIGINT) AS toxic_lost
  FROM g, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
""")
def op12_filter_audit(spark, sf):
    labels = load(spark, sf, "labels")
    known = filter_audit.facts(load(spark, sf, "documents"))
    losses = {"good": labels.where("quality = 1").select("doc_id"), "toxic": labels.where("toxic = 1").select("doc_id")}
    return filter_audit.audit(known, filter_audit.failing(known), losses)


@query("op13_cover_repeats")
def op13_cover_repeats(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    outputs = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    return cover_repeats.remove(docs, outputs=outputs).select("doc_id", *outputs)
