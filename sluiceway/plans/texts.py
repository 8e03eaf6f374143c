"""Queries over documents: normalisation, tripwires, verdicts, decisions, chunks, leaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.functions import text as T
from sluiceway.functions.columns import bind
from sluiceway.operators import decisions, regex_index, reports, requests, tripwires, verdicts
from sluiceway.plans.registry import query
from sluiceway.policy import Policy, category_classes, category_names, make_policy
from sluiceway.session import load, spread

MAIL = r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
SECRET = "password|token"
EXTRA = (MAIL, IPV4, SECRET, "the thing")
GUARD = "llama-guard3:8b"
PHRASE_WORDS = 5


def policy() -> Policy:
    """The policy of the fixture queries: defaults plus a few administrator patterns."""
    return make_policy({"tripwires": {"extra_patterns": list(EXTRA)}, "audit": {"store_snippet": True}})


def documents(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return spread(load(spark, sf, "documents").select("doc_id", "text", *columns))


def normalised(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return bind(documents(spark, sf, *columns), "norm", T.normalise(F.col("text")))


# Building blocks of the SQL twins.
NORM = r"lower(regexp_replace(strip_accents(text), '\s+', ' ', 'g'))"
SQUEEZED = f"regexp_replace({NORM}, '[^a-z0-9]+', '', 'g')"
VERDICT_SQL = """
raw AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'unsafe' || chr(10) || 'S' || (1 + doc_id % 14) ELSE 'safe' END AS raw FROM labels)
"""
BLOCKED_SQL = "('S1','S2','S3','S4','S9','S10','S11')"
NAMES_SQL = """
names(code, name, class) AS (VALUES ('S1','Violent Crimes','illegal'), ('S2','Non-Violent Crimes','illegal'),
  ('S3','Sex-Related Crimes','illegal'), ('S4','Child Sexual Exploitation','locked'), ('S5','Defamation','adult/legal'),
  ('S6','Specialized Advice','adult/legal'), ('S7','Privacy','adult/legal'), ('S8','Intellectual Property','adult/legal'),
  ('S9','Indiscriminate Weapons','illegal'), ('S10','Hate','protected'), ('S11','Suicide & Self-Harm','protected'),
  ('S12','Sexual Content','adult/legal'), ('S13','Elections','adult/legal'), ('S14','Code Interpreter Abuse','adult/legal'))
"""


def _pattern_rows(lists: tuple[str, ...]) -> str:
    """The pattern table as SQL VALUES."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rows = tripwires.table(lists, EXTRA)
    return ", ".join(f"({r}, {quoted(n)}, {i}, {quoted(p)})" for r, n, i, p in rows)


def _hits_sql(lists: tuple[str, ...], source: str = "documents", key: str = "doc_id") -> str:
    """First (list, pattern) per text, from an exhaustive comparison of every text and pattern."""
    return f"""
    pats(list_rank, list, pattern_rank, pattern) AS (VALUES {_pattern_rows(lists)}),
    norms AS (SELECT {key}, {NORM} AS norm, {SQUEEZED} AS squeezed FROM {source}),
    every_hit AS (SELECT {key}, list_rank, list, pattern_rank, pattern,
        substr(regexp_extract(CASE WHEN list = 'despaced' THEN squeezed ELSE norm END, pattern, 0, 'is'), 1, 200) AS span
      FROM norms JOIN pats ON regexp_matches(CASE WHEN list = 'despaced' THEN squeezed ELSE norm END, pattern, 'is')),
    hits AS (SELECT * FROM every_hit
      QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY list_rank, pattern_rank) = 1)
    """


@query("normalise_documents", f"SELECT doc_id, length({NORM}) AS chars, sha256({NORM}) AS digest FROM documents")
def normalise_documents(spark, sf):
    norm = normalised(spark, sf)
    return norm.select("doc_id", F.length("norm").cast("long").alias("chars"), F.sha2("norm", 256).alias("digest"))


@query("tripwire_hits", f"WITH {_hits_sql(tripwires.REQUEST_LISTS)} SELECT doc_id, list, pattern, span FROM hits")
def tripwire_hits(spark, sf):
    hits = tripwires.scan(normalised(spark, sf), "norm", tripwires.REQUEST_LISTS, policy().extra_patterns)
    return hits.select("doc_id", "hit.list", "hit.pattern", "span")


@query("output_tripwires", f"WITH {_hits_sql(tripwires.OUTPUT_LISTS, '(SELECT conv_id, turn, conv_id * 100 + turn AS msg, text FROM conversations WHERE role = $$assistant$$)', 'msg')} SELECT msg, list, pattern, span FROM hits")
def output_tripwires(spark, sf):
    turns = spread(load(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("msg"), "text"))
    hits = tripwires.scan(bind(turns, "norm", T.normalise(F.col("text"))), "norm", tripwires.OUTPUT_LISTS, policy().extra_patterns)
    return hits.select("msg", "hit.list", "hit.pattern", "span")


@query("tripwire_despaced", f"SELECT doc_id, length({SQUEEZED}) AS chars, sha256({SQUEEZED}) AS digest, regexp_matches({SQUEEZED}, '{'|'.join(tripwires.DESPACED)}') AS hit FROM documents")
def tripwire_despaced(spark, sf):
    squeezed = normalised(spark, sf).withColumn("d", T.despaced(F.col("norm")))
    return squeezed.select(
        "doc_id", F.length("d").cast("long").alias("chars"), F.sha2("d", 256).alias("digest"),
        F.col("d").rlike("|".join(tripwires.DESPACED)).alias("hit"),
    )


@query("tripwire_first_hit", f"""
WITH {_hits_sql(tripwires.REQUEST_LISTS, "(SELECT source, doc_id, text FROM documents)", "source, doc_id")},
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY source ORDER BY list_rank, doc_id, pattern_rank) = 1),
n AS (SELECT source, count(*) AS texts FROM documents GROUP BY source)
SELECT source, doc_id AS text_rank, list, pattern, span FROM firsts
""".replace("PARTITION BY source, doc_id ORDER", "PARTITION BY doc_id ORDER"))
def tripwire_first_hit(spark, sf):
    hits = tripwires.scan(normalised(spark, sf, "source"), "norm", tripwires.REQUEST_LISTS, policy().extra_patterns)
    return tripwires.first_hit(hits, "source", "doc_id")


@query("pattern_join", f"""
WITH phrases AS (SELECT item_id, array_to_string(list_filter(string_split({NORM}, ' '), lambda w: w <> ''), ' ') AS phrase FROM benchmark),
d AS (SELECT doc_id, ' ' || array_to_string(list_filter(string_split({NORM}, ' '), lambda w: w <> ''), ' ') || ' ' AS norm FROM documents)
SELECT item_id, doc_id FROM phrases JOIN d ON phrase <> '' AND contains(norm, ' ' || phrase || ' ')
""")
def pattern_join(spark, sf):
    """Documents that hold the whole text of a benchmark item."""
    items = bind(load(spark, sf, "benchmark").select("item_id", "text"), "phrase", T.normalise(F.col("text")))
    return tripwires.phrase_join(documents(spark, sf), "doc_id", "text", items, "item_id", "phrase", PHRASE_WORDS, T.normalise)


REGEX_SQL = """SELECT item_id, w[1] || '[ \n]+' || w[2] || '[ \n,.]+(?:' || w[3] || '|' || w[4] || ')' AS pattern
FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM benchmark) WHERE len(w) >= 4
UNION ALL SELECT item_id + 1000000, '(?:' || w[1] || '|' || w[2] || w[3] || ')[a-z]+ ' || w[4] FROM (SELECT item_id, regexp_extract_all(text, '[A-Za-z]{4,}') AS w FROM benchmark) WHERE len(w) >= 4
UNION ALL SELECT -1, '[0-9]{3}-[0-9]{4}' UNION ALL SELECT -2, '\\$[0-9]+'"""


@query("regex_join", f"""WITH p AS ({REGEX_SQL}) SELECT item_id, doc_id FROM p JOIN documents ON regexp_matches(text, pattern, 'is')""")
def regex_join(spark, sf):
    """Documents that match expressions made from the benchmark items, and two without literals."""
    w = F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))
    items = load(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 4)
    at = lambda k: F.get("w", F.lit(k))
    first = F.concat(at(0), F.lit("[ \n]+"), at(1), F.lit("[ \n,.]+(?:"), at(2), F.lit("|"), at(3), F.lit(")"))
    second = F.concat(F.lit("(?:"), at(0), F.lit("|"), at(1), at(2), F.lit(")[a-z]+ "), at(3))
    made = items.select(F.explode(F.array(F.struct("item_id", first.alias("pattern")), F.struct((F.col("item_id") + 1_000_000).alias("item_id"), second.alias("pattern")))).alias("p")).select("p.*")
    bare = spark.createDataFrame([(-1, "[0-9]{3}-[0-9]{4}"), (-2, r"\$[0-9]+")], "item_id long, pattern string")
    return regex_index.regex_join(spread(load(spark, sf, "documents").select("doc_id", "text")), "doc_id", "text", made.unionByName(bare), "item_id", "pattern")


# ---- verdicts --------------------------------------------------------------------------------

def raw_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Classifier answers of the labelled documents."""
    unsafe = F.concat(F.lit("unsafe\nS"), (F.col("doc_id") % 14 + 1).cast("string"))
    return load(spark, sf, "labels").select(
        "doc_id", F.lit(GUARD).alias("model"), F.when(F.col("toxic") == 1, unsafe).otherwise("safe").alias("raw")
    )


def parsed_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return raw_verdicts(spark, sf).withColumn("v", verdicts.parse(F.col("model"), F.col("raw")))


@query("verdict_parse", f"""WITH {VERDICT_SQL}
SELECT doc_id, 'ok' AS status, raw LIKE 'unsafe%' AS unsafe, array_to_string(regexp_extract_all(raw, 'S\\d+'), ',') AS codes FROM raw""")
def verdict_parse(spark, sf):
    return parsed_verdicts(spark, sf).select("doc_id", "v.status", "v.unsafe", F.array_join("v.codes", ",").alias("codes"))


@query("verdict_blocked", f"""WITH {VERDICT_SQL}, c AS (SELECT doc_id, raw, regexp_extract(raw, 'S\\d+') AS code FROM raw)
SELECT doc_id, CASE WHEN code IN {BLOCKED_SQL} THEN code ELSE '' END AS blocked, code IN {BLOCKED_SQL} AS refused FROM c""")
def verdict_blocked(spark, sf):
    outcome = verdicts.outcome(F.col("v"), policy())
    return parsed_verdicts(spark, sf).withColumn("o", outcome).select(
        "doc_id", F.array_join("o.codes", ",").alias("blocked"), (F.col("o.rank") < 2).alias("refused")
    )


@query("verdict_names", f"""WITH {VERDICT_SQL}, {NAMES_SQL}
SELECT doc_id, coalesce(code || ' ' || name, '') AS names, coalesce(class, '') AS classes
FROM (SELECT doc_id, regexp_extract(raw, 'S\\d+') AS c FROM raw) LEFT JOIN names ON code = c""")
def verdict_names(spark, sf):
    codes = F.col("v.codes")
    return parsed_verdicts(spark, sf).select("doc_id", category_names(codes).alias("names"), category_classes(codes).alias("classes"))


@query("adapter_route", """
SELECT user_id, model, adapter, CASE WHEN adapter IS NOT NULL THEN '' WHEN regexp_matches(model, 'shield|guardian|wildguard', 'i')
  THEN 'recognised safety family without an adapter yet' ELSE 'unknown model family' END AS note
FROM (SELECT user_id, model, CASE WHEN regexp_matches(model, 'llama-?guard', 'i') THEN 'llama_guard' END AS adapter
  FROM (SELECT DISTINCT user_id, CASE user_id % 5 WHEN 0 THEN 'Llama-Guard3:1b' WHEN 1 THEN 'llamaguard:7b' WHEN 2 THEN 'shieldgemma:2b'
    WHEN 3 THEN 'granite3-guardian:8b' ELSE 'mixtral' END AS model FROM events))
""")
def adapter_route(spark, sf):
    kind = F.col("user_id") % 5
    model = F.when(kind == 0, "Llama-Guard3:1b").when(kind == 1, "llamaguard:7b").when(kind == 2, "shieldgemma:2b").when(
        kind == 3, "granite3-guardian:8b").otherwise("mixtral")
    used = load(spark, sf, "events").select("user_id", model.alias("model")).distinct()
    adapter = verdicts.adapter_name(F.col("model"))
    return used.select("user_id", "model", adapter.alias("adapter"), F.when(adapter.isNotNull(), "").otherwise(verdicts.family_note(F.col("model"))).alias("note"))


def _chunk_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of every chunk: toxic documents are unsafe from their second chunk on (or in their
    only one), unlabelled documents were not answered."""
    chunks = requests.chunks(documents(spark, sf)).select("doc_id", "chunk_idx")
    last = chunks.groupBy("doc_id").agg(F.max("chunk_idx").alias("last_idx"))
    answered = chunks.join(last, "doc_id").join(raw_verdicts(spark, sf), "doc_id", "left")
    raw = F.when((F.col("raw") != "safe") & (F.col("chunk_idx") < F.least(F.col("last_idx"), F.lit(1))), "safe").otherwise(F.col("raw"))
    return answered.withColumn("v", verdicts.parse(F.lit(GUARD), raw))


CHUNKS_SQL = """
starts AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 5400)) AS start FROM documents),
chunks AS (SELECT doc_id, CAST(start / 5400 AS INTEGER) AS chunk_idx, start, substr(text, start + 1, 6000) AS chunk FROM starts
  WHERE regexp_matches(substr(text, start + 1, 6000), '\\S'))
"""


@query("request_verdict", f"""
WITH {VERDICT_SQL}, {CHUNKS_SQL},
l AS (SELECT doc_id, max(chunk_idx) AS last_idx, count(*) AS calls, min(chunk_idx) AS first_idx FROM chunks GROUP BY doc_id),
j AS (SELECT l.*, raw, regexp_extract(raw, 'S\\d+') AS code FROM l LEFT JOIN raw USING (doc_id))
SELECT doc_id, calls,
  CAST(CASE WHEN code IN {BLOCKED_SQL} THEN least(last_idx, 1) ELSE first_idx END AS INTEGER) AS decided_by,
  (raw IS NULL OR code IN {BLOCKED_SQL}) AS refused,
  CASE WHEN raw IS NULL THEN 'guard_unavailable' WHEN code IN {BLOCKED_SQL} THEN 'classifier' END AS reason,
  CASE WHEN code IN {BLOCKED_SQL} THEN code ELSE '' END AS codes FROM j
""")
def request_verdict(spark, sf):
    out = verdicts.request_verdict(_chunk_verdicts(spark, sf), "doc_id", "chunk_idx", "v", policy())
    return out.withColumn("codes", F.array_join("codes", ","))


# ---- decisions -------------------------------------------------------------------------------

def _decided(spark: SparkSession, sf: str) -> DataFrame:
    """One decision per document: tripwires, then the classifier, unanswered refused."""
    docs = normalised(spark, sf, "source")
    hits = tripwires.scan(docs, "norm", tripwires.REQUEST_LISTS, policy().extra_patterns).select("doc_id", "hit.list", "hit.pattern", "span")
    verdict = parsed_verdicts(spark, sf).withColumn("o", verdicts.outcome(F.col("v"), policy())).select(
        "doc_id", (F.col("o.rank") < 2).alias("refused"), "o.reason", "o.codes"
    )
    return decisions.decide(load(spark, sf, "documents").select("doc_id", "source"), "doc_id", hits, verdict)


DECISIONS_SQL = f"""
WITH {VERDICT_SQL}, {_hits_sql(tripwires.REQUEST_LISTS)},
j AS (SELECT d.doc_id, source, list, raw, regexp_extract(raw, 'S\\d+') AS code
  FROM documents d LEFT JOIN hits USING (doc_id) LEFT JOIN raw ON raw.doc_id = d.doc_id),
decided AS (SELECT doc_id, source, CASE WHEN list IS NOT NULL THEN 'regex:' || list WHEN raw IS NULL THEN 'guard_unavailable'
    WHEN code IN {BLOCKED_SQL} THEN 'classifier' END AS reason FROM j)
"""


@query("decisions", f"""{DECISIONS_SQL}
SELECT doc_id, coalesce(reason, 'pass') AS reason, CAST(CASE WHEN reason IS NULL THEN 200 WHEN reason = 'guard_unavailable' THEN 503 ELSE 400 END AS INTEGER) AS status,
  CASE WHEN reason IS NULL THEN 'pass' WHEN reason = 'guard_unavailable' THEN reason ELSE 'veto_triggered' END AS code FROM decided""")
def document_decisions(spark, sf):
    return _decided(spark, sf).select("doc_id", F.coalesce("reason", F.lit("pass")).alias("reason"), "status", "code")


@query("refusals_by_source", f"""{DECISIONS_SQL}
SELECT source, coalesce(reason, 'pass') AS reason, count(*) AS documents FROM decided GROUP BY ALL""")
def refusals_by_source(spark, sf):
    """Which documents would be refused, why, and how many per source?"""
    return _decided(spark, sf).groupBy("source", F.coalesce("reason", F.lit("pass")).alias("reason")).agg(F.count(F.lit(1)).alias("documents"))


# ---- chunks, fragments, clean-up -------------------------------------------------------------

@query("chunk_documents", f"WITH {CHUNKS_SQL} SELECT doc_id, chunk_idx, start, length(chunk) AS chars, sha256(chunk) AS digest FROM chunks")
def chunk_documents(spark, sf):
    chunks = requests.chunks(documents(spark, sf))
    return chunks.select("doc_id", "chunk_idx", F.col("start").cast("long").alias("start"), F.length("chunk").cast("long").alias("chars"), F.sha2("chunk", 256).alias("digest"))


@query("budget_exceeded", """
SELECT source, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(CAST(ceil(greatest(length(text), 1) / 5400) AS BIGINT)) AS BIGINT) AS chunks,
  sum(CAST(ceil(greatest(length(text), 1) / 5400) AS BIGINT)) > 100 AS over_chunks, sum(length(text)) > 400000 AS over_chars, count(*) > 20000 AS over_pieces
FROM documents GROUP BY source""")
def budget_exceeded(spark, sf):
    docs = load(spark, sf, "documents").select("source", F.length("text").alias("n"))
    sizes = docs.groupBy("source").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").cast("long").alias("chars"), F.sum(requests.chunk_count(F.col("n"))).cast("long").alias("chunks")
    )
    return sizes.withColumns({"over_chunks": F.col("chunks") > 100, "over_chars": F.col("chars") > 400_000, "over_pieces": F.col("texts") > 20_000})


BREAK = r"([A-Za-z0-9+/_-]{4}={0,2})[ \t]*\r?\n[ \t]*([A-Za-z0-9+/_-]{4})"
RUN = "[A-Za-z0-9+/_-]{16,}"
_PAD = "rpad(translate(run, '-_', '+/'), CAST(ceil(length(run) / 4.0) * 4 AS INTEGER), '=')"


@query("base64_fragments", f"""
WITH c AS (SELECT doc_id, regexp_replace(text, '[\\x{{200b}}-\\x{{200f}}\\x{{2060}}-\\x{{2064}}\\x{{feff}}\\x{{00ad}}]', '', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, regexp_replace(regexp_replace(regexp_replace(t, '{BREAK}', '\\1\\2', 'g'), '{BREAK}', '\\1\\2', 'g'), '{BREAK}', '\\1\\2', 'g') AS glued FROM c),
r AS (SELECT DISTINCT doc_id, unnest(list_concat(regexp_extract_all(t, '{RUN}'), regexp_extract_all(glued, '{RUN}'))) AS run FROM g),
d AS (SELECT doc_id, TRY(decode(from_base64({_PAD}))) AS raw FROM r WHERE length(run) % 4 <> 1),
s AS (SELECT DISTINCT doc_id, raw, regexp_replace(raw, '[\\pC\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}--\\n\\t\\r]', '', 'g') AS fragment FROM d WHERE raw IS NOT NULL)
SELECT DISTINCT doc_id, fragment FROM s WHERE regexp_matches(fragment, '\\S') AND length(fragment) * 2 >= length(raw)
""".replace("[\\pC", "[^\\PC\\n\\t\\r]|[").replace("--\\n\\t\\r]", "]"))
def base64_fragments(spark, sf):
    return documents(spark, sf).select("doc_id", F.explode(T.base64_fragments(F.col("text"))).alias("fragment"))


PRIVATE = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<mail>"), (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "<ip>")]
NAMED = [("password", "<secret>"), ("token", "<token>")]


@query("redact_documents", rf"""
WITH r AS (SELECT doc_id, replace(replace(regexp_replace(regexp_replace(text, '{PRIVATE[0][0]}', '<mail>', 'g'), '{PRIVATE[1][0]}', '<ip>', 'g'),
  'password', '<secret>'), 'token', '<token>') AS t FROM documents)
SELECT doc_id, length(t) AS chars, sha256(t) AS digest FROM r""")
def redact_documents(spark, sf):
    text = reports.redact(reports.redact_patterns(F.col("text"), PRIVATE), NAMED)
    return documents(spark, sf).withColumn("t", text).select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("digest"))


@query("leak_scan", rf"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS line_no FROM l),
h AS (SELECT * FROM x WHERE regexp_matches(line, '(?i){PRIVATE[0][0]}|{PRIVATE[1][0]}|password|token'))
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, sha256(line) AS digest FROM h""")
def leak_scan(spark, sf):
    hits = reports.leak_scan(documents(spark, sf), "doc_id", "text", [PRIVATE[0][0], PRIVATE[1][0], "password", "token"])
    return hits.select("doc_id", "line_no", F.sha2("line", 256).alias("digest"))


# The entities met in the pages; ``&amp;`` is resolved last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"))
_ENTITIES_SQL = r"regexp_replace(regexp_replace(coalesce(html, ''), '<br\s*/?>|</p>|</li>', chr(10), 'g'), '<[^>]+>', '', 'g')"
for _name, _char in ENTITIES:
    _ENTITIES_SQL = "replace(%s, '%s', '%s')" % (_ENTITIES_SQL, _name, _char.replace("'", "''"))
_ENTITIES_SQL = f"regexp_replace({_ENTITIES_SQL}, '&amp;?', '&', 'g')"


@query("strip_html", rf"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace({_ENTITIES_SQL}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g') AS t FROM pages)
SELECT page_id, t AS text FROM t""")
def strip_html(spark, sf):
    return spread(load(spark, sf, "pages").select("page_id", "html")).select("page_id", T.strip_html(F.col("html")).alias("text"))


# Letters of Latin texts written with Cyrillic and Greek look-alikes, full width and zero-width marks.
DISGUISE = str.maketrans("aeopcxyABEHKMTv", "аеорсхуΑΒΕΗΚΜΤν")


@query("lookalike_documents", f"SELECT doc_id, sha256({NORM}) AS digest FROM documents")
def lookalike_documents(spark, sf):
    """Documents disguised letter by letter have the normal form of the originals."""
    letters = "".join(map(chr, DISGUISE))
    disguised = F.regexp_replace(F.translate("text", letters, letters.translate(DISGUISE)), "t", "\u200bｔ")
    norm = bind(documents(spark, sf).select("doc_id", disguised.alias("text")), "norm", T.normalise(F.col("text")))
    return norm.select("doc_id", F.sha2("norm", 256).alias("digest"))


@query("page_names", r"""SELECT page_id, string_split(replace(url, '\', '/'), '/')[-1] AS name, regexp_replace(url || '/width=90,x/', '/(original=true|width=\d+)[^/]*/', '/width=450,anim=false/', 'g') AS preview FROM pages""")
def page_names(spark, sf):
    """Last part of each address, and the address as a preview of fixed width."""
    pages = load(spark, sf, "pages").select("page_id", "url")
    return pages.select("page_id", T.base_name(F.col("url")).alias("name"), T.preview_url(F.concat("url", F.lit("/width=90,x/"))).alias("preview"))
