"""Registry listings in one item schema, admission rules, and what fits on which card."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.text import preview_url, readable_size

# Fixed values.
TOP = 30
SAFE_FORMATS = r"(?i)\.(safetensors|gguf)$"
PICKLE_FORMATS = r"(?i)\.(ckpt|pt|pth|bin|pkl)$"
ADULT_TAG = "not-for-all-audiences"
MAX_PREVIEW_LEVEL = 2
PREVIEWS_PER_VERSION, PREVIEWS_PER_ITEM = 6, 12
TAGS_SHOWN = 8
GIB = 1 << 30
MIB = 1 << 20
NEED = {"llm": (1.20, 1.5), "image": (1.35, 2.0)}
HUB_URL = "https://huggingface.co/"
GALLERY_URL = "https://civitai.com/models/"

HUB_LISTING = (
    "id string, tags array<string>, pipeline_tag string, library_name string, downloads bigint, likes bigint, "
    "createdAt string, gated string"
)
FILE = "struct<name:string, sizeKB:double, primary:boolean, pickleScanResult:string, virusScanResult:string>"
IMAGE = "struct<url:string, nsfwLevel:int, type:string, width:int, height:int>"
VERSION = (
    f"struct<id:bigint, name:string, baseModel:string, publishedAt:string, availability:string, paidAccess:string, "
    f"earlyAccessEndsAt:string, earlyAccessDeadline:string, files:array<{FILE}>, images:array<{IMAGE}>>"
)
GALLERY_LISTING = (
    "id bigint, name string, type string, nsfw boolean, tags array<string>, creator struct<username:string>, "
    f"stats struct<downloadCount:bigint, thumbsUpCount:bigint>, modelVersions array<{VERSION}>"
)


def _filled(value: Column) -> Column:
    """A value that counts as present: not missing, empty, false or null text."""
    return F.coalesce(~value.isin("", "false", "null", "0"), F.lit(False))


def _orr(value: Column, default) -> Column:
    return F.coalesce(value, F.lit(default))


def hub_items(raw: DataFrame, adult: bool = False) -> DataFrame:
    """Items of a hub listing, one JSON object per row in ``json``."""
    d = raw.select(F.from_json("json", HUB_LISTING).alias("d")).select("d.*")
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    nsfw = F.array_contains(tags, ADULT_TAG)
    kind = F.coalesce(
        F.when(F.col("pipeline_tag") != "", F.col("pipeline_tag")),
        F.when(F.array_contains(tags, "gguf"), F.lit("gguf")), F.col("library_name"), F.lit(""),
    )
    items = d.select(
        F.lit("hf").alias("src"), _orr(F.col("id"), "").alias("id"),
        F.regexp_replace(_orr(F.col("id"), ""), "^[^/]*/", "").alias("name"),
        F.regexp_extract(_orr(F.col("id"), ""), "^([^/]*)/", 1).alias("author"),
        kind.alias("type"), F.slice(tags, 1, TAGS_SHOWN).alias("tags"), nsfw.alias("nsfw"),
        _orr(F.col("downloads"), 0).alias("downloads"), _orr(F.col("likes"), 0).alias("likes"),
        F.substring(_orr(F.col("createdAt"), ""), 1, 10).alias("updated"), F.lit(None).cast("string").alias("thumb"),
        F.lit("").alias("base"), F.lit(False).alias("buzz"), F.lit(None).cast("double").alias("size"),
        _filled(F.col("gated")).alias("gated"), F.concat(F.lit(HUB_URL), _orr(F.col("id"), "")).alias("url"),
    )
    return items if adult else items.where(~F.col("nsfw"))


def previews(images: Column, adult: bool) -> Column:
    """Images that may be shown: with adult content off, only the two mildest levels."""
    return F.coalesce(images, F.array().cast(f"array<{IMAGE}>")) if adult else F.filter(
        F.coalesce(images, F.array().cast(f"array<{IMAGE}>")),
        lambda im: F.coalesce(F.when(im["nsfwLevel"] != 0, im["nsfwLevel"]), F.lit(1)) <= MAX_PREVIEW_LEVEL,
    )


def thumbnail(images: Column, adult: bool) -> Column:
    """First permitted preview with an address."""
    usable = F.filter(previews(images, adult), lambda im: im["url"] != "")
    return preview_url(F.try_element_at(usable, F.lit(1))["url"])


def early_access(version: Column) -> Column:
    return (
        F.coalesce(version["availability"] == "EarlyAccess", F.lit(False)) | _filled(version["paidAccess"])
        | _filled(version["earlyAccessEndsAt"]) | _filled(version["earlyAccessDeadline"])
    )


def primary_file(files: Column) -> Column:
    """The file marked primary, else the first."""
    return F.coalesce(F.try_element_at(F.filter(files, lambda f: f["primary"]), F.lit(1)), F.try_element_at(files, F.lit(1)))


def gallery_items(raw: DataFrame, adult: bool = False) -> DataFrame:
    """Items of a gallery listing, one JSON object per row in ``json``."""
    d = raw.select(F.from_json("json", GALLERY_LISTING).alias("d")).select("d.*")
    v = F.try_element_at("modelVersions", F.lit(1))
    items = d.select(
        F.lit("civitai").alias("src"), F.col("id").cast("string").alias("id"), _orr(F.col("name"), "").alias("name"),
        _orr(F.col("creator.username"), "").alias("author"), _orr(F.col("type"), "").alias("type"),
        F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, TAGS_SHOWN).alias("tags"), _orr(F.col("nsfw"), False).alias("nsfw"),
        _orr(F.col("stats.downloadCount"), 0).alias("downloads"), _orr(F.col("stats.thumbsUpCount"), 0).alias("likes"),
        F.substring(_orr(v["publishedAt"], ""), 1, 10).alias("updated"), thumbnail(v["images"], adult).alias("thumb"),
        _orr(v["baseModel"], "").alias("base"),
        F.coalesce(F.exists("modelVersions", early_access), F.lit(False)).alias("buzz"),
        (F.coalesce(primary_file(v["files"])["sizeKB"], F.lit(0.0)) * 1024).alias("size"),
        F.lit(False).alias("gated"), F.concat(F.lit(GALLERY_URL), F.col("id").cast("string")).alias("url"),
    )
    return items if adult else items.where(~F.col("nsfw"))


PROVIDERS = {"hf": hub_items, "civitai": gallery_items}


def items(listings: dict[str, DataFrame], adult: bool = False, providers: dict = PROVIDERS) -> DataFrame:
    """All providers' items in one schema; add a provider by adding its ``raw -> items`` function."""
    out = None
    for name, raw in listings.items():
        part = providers[name](raw, adult)
        out = part if out is None else out.unionByName(part)
    return out


def version_previews(raw: DataFrame, adult: bool = False) -> DataFrame:
    """Up to six previews per version and twelve per item, in order."""
    d = raw.select(F.from_json("json", GALLERY_LISTING).alias("d")).select("d.id", "d.modelVersions")
    per_version = F.transform("modelVersions", lambda v: F.slice(previews(v["images"], adult), 1, PREVIEWS_PER_VERSION))
    shown = F.slice(F.flatten(per_version), 1, PREVIEWS_PER_ITEM)
    return d.select(F.col("id").cast("string").alias("id"), F.posexplode(shown).alias("pos", "im")).select(
        "id", "pos", preview_url(F.col("im.url")).alias("thumb"), F.coalesce("im.type", F.lit("image")).alias("type")
    )


def top(catalogue: DataFrame, by: str = "downloads", n: int = TOP, tie: str = "id") -> DataFrame:
    """The first ``n`` items by downloads, likes or date; only ``n`` rows per task are compared."""
    column = {"downloads": "downloads", "likes": "likes", "newest": "updated"}.get(by, "downloads")
    return catalogue.orderBy(F.col(column).desc(), F.col(tie)).limit(n)


def admission(name: Column, pickle_scan: Column | None = None, virus_scan: Column | None = None) -> tuple[Column, Column]:
    """(admitted, why) of a file by its format and the registry's scans."""
    def clean(scan: Column | None) -> Column:
        return F.lit(True) if scan is None else scan.isNull() | (scan == "Success")

    scans = clean(pickle_scan) & clean(virus_scan)
    why = (
        F.when(~scans, "registry scan not clean").when(name.rlike(SAFE_FORMATS), "ok")
        .when(name.rlike(PICKLE_FORMATS), "pickle format refused").otherwise("unsupported format")
    )
    return why == "ok", why


# ---- capacity --------------------------------------------------------------------------------

def need_bytes(size: Column, kind: str) -> Column:
    factor, extra = NEED.get(kind, NEED["image"])
    return size * F.lit(factor) + F.lit(extra * GIB)


def capacity_fit(items_: DataFrame, size: str, cards: list[dict], kind: str = "image") -> DataFrame:
    """Where each item fits: on a card now, after unloading, spread over a pool, or nowhere.

    The cards are an installation's inventory (a short literal list), so every item is judged
    against an array in its own row; there is no join.
    """
    need = need_bytes(F.col(size), kind)
    listed = F.array(*[
        F.struct(F.lit(c["name"]).alias("name"), F.lit(float(c["mem_total"] * MIB)).alias("total"), F.lit(float(c["mem_free"] * MIB)).alias("free"))
        for c in cards
    ])
    pools: dict[str, list[int]] = {}
    for c in cards:
        pools.setdefault(c["pool"], []).append(c["mem_total"] * MIB)
    pooled = F.array(*[
        F.struct(
            F.concat(F.lit(f"{name} pool ({len(sizes)}×"), readable_size(F.lit(sizes[0])), F.lit(")")).alias("label"),
            F.lit(float(sum(sizes))).alias("total"),
        )
        for name, sizes in pools.items()
    ])

    def names(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda c: c["name"]))), "/")

    now = F.filter(listed, lambda c: F.col("need") <= c["free"])
    later = F.filter(listed, lambda c: (F.col("need") > c["free"]) & (F.col("need") <= c["total"]))
    spread = F.filter(pooled, lambda p: p["total"] >= F.col("need"))
    label = F.when(F.size(now) > 0, F.concat(F.lit("fits now on "), names(now))).when(
        F.size(later) > 0, F.concat(F.lit("fits on "), names(later), F.lit(" after unload"))
    )
    if kind == "llm":
        label = label.when(F.size(spread) > 0, F.concat(F.lit("spread across "), F.array_join(F.transform(spread, lambda p: p["label"]), ", ")))
    label = F.when(F.coalesce(F.col(size), F.lit(0)) == 0, "unknown").otherwise(F.coalesce(label, F.lit("won't fit one card")))
    return items_.withColumn("need", need).withColumn("fit", label)


def pool_memory(cards: DataFrame) -> DataFrame:
    return cards.groupBy("pool").agg(F.sum("mem_total").alias("mem_total"), F.sum("mem_free").alias("mem_free"))


def installed_models(installed: DataFrame, resident: DataFrame) -> DataFrame:
    """Installed models with their residency (J on name) and classifier flag."""
    loaded = resident.select("name", F.col("size_vram").alias("vram"), "pool", F.lit(True).alias("loaded"))
    return installed.join(loaded, "name", "left").withColumns({
        "loaded": F.coalesce("loaded", F.lit(False)), "vram": F.coalesce("vram", F.lit(0)),
        "is_guard": F.col("name").rlike("(?i)guard|shield|guardian"),
    })


def engine_name(name: Column) -> Column:
    """Model name without its provider prefix and default tag."""
    return F.regexp_replace(F.regexp_replace(name, r"^(ollama|ollama_chat)/", ""), ":latest$", "")


def exposed_models(exposed: DataFrame, resident: DataFrame) -> DataFrame:
    """Exposed models of the local engine, resident ones first, then by name."""
    local = exposed.where((F.col("name") != "") & F.col("model").rlike("^(ollama|ollama_chat)/")).withColumn("engine", engine_name(F.col("model")))
    live = resident.select(engine_name(F.col("name")).alias("engine")).distinct().withColumn("resident", F.lit(True))
    joined = local.join(live, "engine", "left").withColumn("resident", F.coalesce("resident", F.lit(False)))
    return joined.orderBy(F.col("resident").desc(), "name")
