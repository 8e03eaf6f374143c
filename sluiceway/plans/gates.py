"""Queries over orders, parts and embeddings: gates, catalogue, capacity, signatures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.operators import catalogue, imagegate, reports
from sluiceway.plans.registry import query
from sluiceway.session import iso_text, load, spread

GIB = 1 << 30
CARDS = [
    {"pool": "alpha", "name": "A16", "mem_total": 16_384, "mem_free": 9_000},
    {"pool": "alpha", "name": "B16", "mem_total": 16_384, "mem_free": 15_000},
    {"pool": "beta", "name": "C24", "mem_total": 24_576, "mem_free": 2_000},
    {"pool": "beta", "name": "D24", "mem_total": 24_576, "mem_free": 24_000},
]


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as registered files: every third size is adult, every third not registered at all."""
    part = load(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.col("p_size"))
    return part.where("p_size % 3 <> 2").select("name", F.when(F.col("p_size") % 3 == 1, "yes").otherwise("no").alias("nsfw"))


REGISTRY_SQL = "reg AS (SELECT p_partkey AS name, CASE WHEN p_size % 3 = 1 THEN 'yes' ELSE 'no' END AS nsfw FROM part WHERE p_size % 3 <> 2)"


def references(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as file references of a workflow."""
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_partkey").alias("name"), F.col("l_linenumber").alias("pos"))


@query("distinct_refs", "SELECT l_orderkey AS workflow, l_partkey AS name, min(l_linenumber) AS first_pos FROM lineitem GROUP BY ALL")
def distinct_refs(spark, sf):
    return imagegate.distinct_refs(references(spark, sf), "workflow", "name", "pos")


@query("file_gate", f"""
WITH {REGISTRY_SQL},
r AS (SELECT l_orderkey AS workflow, l_linenumber AS pos, l_partkey AS name, coalesce(nsfw, 'unclassified') AS flag, o_custkey % 2 = 0 AS nsfw_grant, o_custkey % 10 < 3 AS admin
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN reg ON name = l_partkey),
x AS (SELECT *, CASE WHEN flag = 'yes' AND NOT nsfw_grant THEN CAST(name AS VARCHAR) || ' is marked NSFW and your account does not have the NSFW grant'
  WHEN flag = 'unclassified' AND NOT admin THEN CAST(name AS VARCHAR) || ' has not been classified by an administrator yet' END AS reason FROM r),
f AS (SELECT workflow, first(reason ORDER BY pos, reason) FILTER (reason IS NOT NULL) AS reason FROM x GROUP BY workflow)
SELECT o_orderkey AS workflow, reason, reason IS NULL AS allowed FROM orders LEFT JOIN f ON workflow = o_orderkey""")
def file_gate(spark, sf):
    """Workflows whose files their owner may not use, and the first reason."""
    owners = load(spark, sf, "orders").select(
        F.col("o_orderkey").alias("workflow"), (F.col("o_custkey") % 2 == 0).alias("nsfw_grant"), (F.col("o_custkey") % 10 < 3).alias("admin")
    )
    return imagegate.file_gate(owners, references(spark, sf), registry(spark, sf), "workflow", "name", "pos")


@query("foreign_inputs", """
SELECT o_orderkey AS workflow, o_custkey AS owner, l_suppkey AS input FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_nationkey = o_custkey % 25)""")
def foreign_inputs(spark, sf):
    """Inputs (suppliers) that do not belong to the order's customer: owned means same nation."""
    orders = load(spark, sf, "orders").select(F.col("o_orderkey").alias("workflow"), F.col("o_custkey").alias("owner"), (F.col("o_custkey") % 25).alias("group"))
    lines = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_suppkey").alias("input"))
    owned = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("input"), F.col("s_nationkey").cast("long").alias("group"))
    return imagegate.foreign_inputs(orders.join(lines, "workflow"), owned, ["input", "group"]).select("workflow", "owner", "input")


@query("allowed_items", f"""WITH {REGISTRY_SQL},
c AS (SELECT l_orderkey AS workflow, l_linenumber AS pos, CASE WHEN l_linenumber % 4 = 3 THEN -l_partkey ELSE l_partkey END AS name FROM lineitem)
SELECT c.* FROM c LEFT JOIN reg USING (name) WHERE reg.name IS NULL OR nsfw = 'no'""")
def allowed_items(spark, sf):
    """Choices of an account without the adult grant; negative names are not files."""
    known = registry(spark, sf)
    name = F.when(F.col("pos") % 4 == 3, -F.col("name")).otherwise(F.col("name"))
    choices = references(spark, sf).withColumn("name", name)
    return imagegate.filter_choices(choices, known, imagegate.allowed_names(known, nsfw_grant=False), "name").select("workflow", "pos", "name")


@query("own_history", """
SELECT l_orderkey AS workflow, l_linenumber AS pos, l_shipdate::DATE::VARCHAR AS shipped FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')""")
def own_history(spark, sf):
    """History of the customers of one segment."""
    mine = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    orders = load(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("workflow")).join(mine, "o_custkey", "left_semi")
    lines = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("pos"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped")
    )
    return reports.own_rows(lines, orders, "workflow")


@query("gallery_counts", "SELECT o_custkey AS owner, count(*) AS items FROM orders GROUP BY o_custkey")
def gallery_counts(spark, sf):
    return reports.items_per_user(load(spark, sf, "orders").select(F.col("o_custkey").alias("owner")), "owner")


_VERDICT_FLAGS = """l_returnflag = 'R' AS nsfw, l_returnflag = 'A' AND l_linenumber % 2 = 0 AS sexual_content, l_linestatus = 'F' AND l_linenumber % 3 = 0 AS minor_present,
 l_linenumber = 6 AS sexual_minor, l_linenumber = 5 AND l_tax > 0.05 AS illegal, l_discount > 0.08 AS violence_gore"""


@query("output_gate", f"""
WITH v AS (SELECT l_orderkey AS workflow, l_linenumber AS pos, l_partkey AS part, l_suppkey AS supplier, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_tax, o_custkey % 2 = 0 AS nsfw_grant, {_VERDICT_FLAGS} FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT workflow, pos, part, supplier, price, CASE WHEN l_tax = 0.08 THEN 'destroy_unparseable' WHEN sexual_minor OR (minor_present AND (nsfw OR sexual_content)) THEN 'destroy_illegal'
  WHEN illegal THEN 'destroy_illegal' WHEN (nsfw OR sexual_content OR violence_gore) AND NOT nsfw_grant THEN 'destroy_nsfw' ELSE 'keep' END AS action,
 CASE WHEN l_tax = 0.08 THEN 'UNPARSEABLE_VERDICT' WHEN sexual_minor OR (minor_present AND (nsfw OR sexual_content)) THEN 'S4' WHEN illegal THEN 'S3'
  WHEN (nsfw OR sexual_content OR violence_gore) AND NOT nsfw_grant THEN 'S12' END AS code,
 l_tax <> 0.08 AND (nsfw OR sexual_content) AS nsfw FROM v""")
def output_gate(spark, sf):
    """Order lines as generated outputs; the verdict document is built from their flags, and lines
    taxed at 8 % carry a text instead of one boolean."""
    line = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), "l_returnflag", "l_linestatus", "l_tax", "l_discount",
    )
    key = ["workflow", "pos", "part", "supplier", "price"]
    n = F.col("pos")
    flags = {
        "nsfw": F.col("l_returnflag") == "R", "sexual_content": (F.col("l_returnflag") == "A") & (n % 2 == 0),
        "minor_present": (F.col("l_linestatus") == "F") & (n % 3 == 0), "sexual_minor": n == 6,
        "illegal": (n == 5) & (F.col("l_tax") > 0.05), "violence_gore": F.col("l_discount") > 0.08,
    }
    document = F.to_json(F.struct(*[v.alias(k) for k, v in flags.items()], F.lit("a scene").alias("description")))
    raw = F.when(F.col("l_tax") == 0.08, F.regexp_replace(document, '"illegal":(true|false)', '"illegal":"$1"')).otherwise(document)
    verdicts = spread(line).select(*key, raw.alias("raw"))
    grants = load(spark, sf, "orders").select(F.col("o_orderkey").alias("workflow"), (F.col("o_custkey") % 2 == 0).alias("nsfw_grant"))
    outputs = line.select(*key).join(grants, "workflow")
    return imagegate.output_gate(outputs, verdicts, key).select(*key, "action", "code", "nsfw")


# ---- catalogue and capacity ------------------------------------------------------------------

@query("catalogue_top", """
SELECT p_partkey AS id, p_name AS name, CAST(round(p_retailprice * 100) AS BIGINT) AS downloads FROM part ORDER BY downloads DESC, id LIMIT 30""")
def catalogue_top(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.round(F.col("p_retailprice") * 100).cast("long").alias("downloads"))
    return catalogue.top(items)


@query("catalogue_items", """
SELECT 'hf' AS src, p_brand || '/' || p_name AS id, p_name AS name, p_brand AS author, CASE WHEN p_size % 4 = 0 THEN 'gguf' ELSE 'diffusers' END AS type,
  p_type || CASE WHEN p_size % 4 = 0 THEN ',gguf' ELSE '' END AS tags, CAST(round(p_retailprice) AS BIGINT) AS downloads, CAST(p_size AS BIGINT) AS likes, p_size % 5 = 0 AS gated, false AS buzz, CAST(NULL AS DOUBLE) AS size FROM part WHERE p_size % 7 <> 0
UNION ALL
SELECT 'civitai', CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, p_type, CAST(round(p_retailprice) AS BIGINT), CAST(p_size AS BIGINT), false, p_size % 6 = 0, CAST(p_size AS DOUBLE) * 1024 FROM part WHERE p_size % 7 <> 0""")
def catalogue_items(spark, sf):
    """Parts as listings of both registries, through their vendor JSON; every seventh size is adult."""
    part = spread(load(spark, sf, "part"))
    adult, price = F.col("p_size") % 7 == 0, F.round("p_retailprice").cast("long")
    tags = F.array_compact(F.array(F.col("p_type"), F.when(F.col("p_size") % 4 == 0, "gguf"), F.when(adult, catalogue.ADULT_TAG)))
    hub = part.select(F.to_json(F.struct(
        F.concat_ws("/", "p_brand", "p_name").alias("id"), tags.alias("tags"), F.when(F.col("p_size") % 4 != 0, "diffusers").alias("library_name"),
        price.alias("downloads"), F.col("p_size").alias("likes"), (F.col("p_size") % 5 == 0).alias("gated"),
    )).alias("json"))
    files = F.array(
        F.struct(F.lit("extra.pt").alias("name"), F.lit(1.0).alias("sizeKB"), F.lit(False).alias("primary")),
        F.struct(F.lit("model.safetensors").alias("name"), F.col("p_size").cast("double").alias("sizeKB"), F.lit(True).alias("primary")),
    )
    version = F.struct(files.alias("files"), F.when(F.col("p_size") % 6 == 0, "EarlyAccess").otherwise("Public").alias("availability"))
    gallery = part.select(F.to_json(F.struct(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), adult.alias("nsfw"), F.array("p_type").alias("tags"),
        F.struct(F.col("p_brand").alias("username")).alias("creator"), F.struct(price.alias("downloadCount"), F.col("p_size").alias("thumbsUpCount")).alias("stats"),
        F.array(version).alias("modelVersions"),
    )).alias("json"))
    items = catalogue.items({"hf": hub, "civitai": gallery})
    return items.select("src", "id", "name", "author", "type", F.array_join("tags", ",").alias("tags"), "downloads", "likes", "gated", "buzz", "size")


_FIT_SQL = """
cards(pool, name, total, free) AS (VALUES {cards}),
n AS (SELECT p_partkey AS item, p_size * 1073741824.0 * {factor} + {extra} * 1073741824.0 AS need FROM part),
f AS (SELECT item, need, string_agg(name, '/' ORDER BY name) FILTER (need <= free * 1048576.0) AS now,
   string_agg(name, '/' ORDER BY name) FILTER (need > free * 1048576.0 AND need <= total * 1048576.0) AS later FROM n, cards GROUP BY ALL)
""".replace("{cards}", ", ".join(f"('{c['pool']}', '{c['name']}', {c['mem_total']}, {c['mem_free']})" for c in CARDS))
_LABEL = "WHEN now IS NOT NULL THEN 'fits now on ' || now WHEN later IS NOT NULL THEN 'fits on ' || later || ' after unload'"


@query("capacity_fit", f"""WITH {_FIT_SQL.replace('{factor}', '1.35').replace('{extra}', '2.0')}
SELECT item, CASE {_LABEL} ELSE 'won''t fit one card' END AS fit FROM f""")
def capacity_fit(spark, sf):
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") * F.lit(float(GIB))).alias("size"))
    return catalogue.capacity_fit(items, "size", CARDS).select("item", "fit")


@query("capacity_fit_spread", f"""WITH {_FIT_SQL.replace('{factor}', '1.2').replace('{extra}', '1.5')}
SELECT item, CASE {_LABEL} WHEN need <= 32768 * 1048576.0 THEN 'spread across alpha pool (2×16.0 GB), beta pool (2×24.0 GB)'
 WHEN need <= 49152 * 1048576.0 THEN 'spread across beta pool (2×24.0 GB)' ELSE 'won''t fit one card' END AS fit FROM f""")
def capacity_fit_spread(spark, sf):
    """Language models may be spread over all cards of a pool."""
    items = load(spark, sf, "part").select(F.col("p_partkey").alias("item"), (F.col("p_size") * F.lit(float(GIB))).alias("size"))
    return catalogue.capacity_fit(items, "size", CARDS, "llm").select("item", "fit")


@query("catalogue_admission", """
SELECT p_partkey AS item, p_size % 5 <> 0 AND p_size % 3 = 0 AS admitted, CASE WHEN p_size % 5 = 0 THEN 'registry scan not clean' WHEN p_size % 3 = 0 THEN 'ok'
  WHEN p_size % 3 = 1 THEN 'pickle format refused' ELSE 'unsupported format' END AS why FROM part""")
def catalogue_admission(spark, sf):
    kind = F.col("p_size") % 3
    name = F.concat("p_name", F.when(kind == 0, ".SafeTensors").when(kind == 1, ".ckpt").otherwise(".zip"))
    admitted, why = catalogue.admission(name, None, F.when(F.col("p_size") % 5 == 0, "Danger").otherwise("Success"))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("item"), admitted.alias("admitted"), why.alias("why"))


# ---- signatures ------------------------------------------------------------------------------

def signatures(spark: SparkSession, sf: str, flipped: int | None = None) -> DataFrame:
    """Signatures of the embeddings; ``flipped`` changes the sign of one value first."""
    vector = F.col("embedding")
    if flipped is not None:
        vector = F.transform(vector, lambda v, i: F.when(i == flipped, -v).otherwise(v))
    return spread(load(spark, sf, "embeddings").select("vec_id", "embedding")).select("vec_id", imagegate.vector_signature(vector).alias("signature"))


def _signature_sql(vector: str) -> str:
    return f"""SELECT vec_id, list_transform({vector}, lambda v: v > list_sort(({vector})[2:])[32]) AS bits FROM embeddings"""


_HEX = "array_to_string(list_transform(range(0, 16), lambda n: lower(to_hex(list_sum(list_transform(range(0, 4), lambda i: CASE WHEN bits[n * 4 + i + 1] THEN CAST(1 AS BIGINT) << (3 - i) ELSE 0 END))))), '')"


@query("vector_signature", f"WITH b AS ({_signature_sql('embedding')}) SELECT vec_id, {_HEX} AS signature FROM b")
def vector_signature(spark, sf):
    return signatures(spark, sf)


_FLIPPED = "list_transform(embedding, lambda v, i: CASE WHEN i = 6 THEN -v ELSE v END)"


@query("signature_matches", f"""
WITH a AS ({_signature_sql('embedding')}), b AS ({_signature_sql(_FLIPPED)}),
d AS (SELECT a.vec_id, b.vec_id AS other, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance FROM a, b)
SELECT vec_id, count(*) AS matches, arg_min(other, distance * 1000000 + other) AS nearest, CAST(min(distance) AS INTEGER) AS distance FROM d WHERE distance <= 3 GROUP BY vec_id""")
def signature_matches(spark, sf):
    """Every vector against holdings in which one value of each vector changed its sign."""
    return imagegate.signature_matches(signatures(spark, sf), signatures(spark, sf, flipped=5), "vec_id", "vec_id")


@query("newest_first", """
SELECT o_custkey AS user, o_orderkey AS item, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS INTEGER) AS rank
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 5""")
def newest_first(spark, sf):
    """A gallery page per customer: the five newest orders."""
    items = load(spark, sf, "orders").select(F.col("o_custkey").alias("user"), F.col("o_orderkey").alias("item"), "o_orderdate")
    return reports.newest_first(items, "user", ["o_orderdate", "item"], 5).select("user", "item", "rank")


@query("threshold_checks", """
SELECT event_id, value < 14 AS warn FROM events""")
def threshold_checks(spark, sf):
    """Event values as days that certificates have left."""
    return reports.expiring(load(spark, sf, "events").select("event_id", F.col("value").alias("days"))).select("event_id", "warn")


@query("image_decision", """
WITH l AS (SELECT l_orderkey AS workflow, l_linenumber AS pos, l_partkey % 7 = 0 AS nsfw, l_partkey % 11 = 0 AS sexual, l_suppkey % 5 = 0 AS minor, l_partkey % 97 = 0 AS sexual_minor,
  l_partkey % 89 = 0 AS illegal, l_suppkey % 13 = 0 AS gore, l_partkey % 17 = 0 AS unread, l_linenumber % 2 = 0 AS nsfw_grant FROM lineitem)
SELECT workflow, pos, CASE WHEN unread THEN 'destroy_unparseable' WHEN sexual_minor OR minor AND (nsfw OR sexual) OR illegal THEN 'destroy_illegal'
  WHEN (nsfw OR sexual OR gore) AND NOT nsfw_grant THEN 'destroy_nsfw' ELSE 'keep' END AS action FROM l""")
def image_decision(spark, sf):
    """Decisions on order lines as images, their verdict flags from part and supplier numbers."""
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    flags = F.struct(
        (part % 7 == 0).alias("nsfw"), (part % 11 == 0).alias("sexual_content"), (supplier % 5 == 0).alias("minor_present"),
        (part % 97 == 0).alias("sexual_minor"), (part % 89 == 0).alias("illegal"), (supplier % 13 == 0).alias("violence_gore"),
    )
    decision = imagegate.decide(F.when(part % 17 != 0, flags), F.col("l_linenumber") % 2 == 0)
    return load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("workflow"), F.col("l_linenumber").alias("pos"), decision["action"].alias("action"))
