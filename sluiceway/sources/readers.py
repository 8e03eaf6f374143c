"""Readers of logs, reports, snapshots and listings, all with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway import schemas

# Folders and formats of a model store.
STORE_FOLDERS = (
    "checkpoints", "loras", "vae", "controlnet", "upscale_models", "embeddings", "motion", "unet", "clip",
    "clip_vision", "diffusion_models", "text_encoders",
)
STORE_FORMATS = r"(?i)\.(safetensors|gguf|ckpt|pt|pth|bin|sft)$"
CORRUPT = "_corrupt_record"


def read_log(spark: SparkSession, path: str, schema: str = schemas.VETO_AUDIT) -> DataFrame:
    """A JSON Lines log; lines that do not parse keep their text in ``_corrupt_record``. A log partitioned by day has the column
    ``dt``, and a filter on it prunes folders."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    day = ["dt"] if "dt" in lines.columns else []
    return lines.select(F.from_json("value", f"{schema}, {CORRUPT} STRING", options).alias("r"), *day).select("r.*", *day)


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined lines): malformed lines are counted and kept, not lost."""
    bad = log.where(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))
    return log.where(F.col(CORRUPT).isNull()).drop(CORRUPT), bad


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Assertion rows of acceptance reports, one JSON document per run."""
    runs = spark.read.schema(schemas.REPORT).option("multiLine", True).json(path)
    return runs.select("label", "ts", F.explode("results").alias("r"), F.col("_metadata.file_name").alias("file")).select(
        "label", "ts", "file", "r.*"
    )


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """(ts, name, status, health, ...) rows of service status snapshots."""
    snapshots = spark.read.schema(schemas.SERVICE_STATUS).option("multiLine", True).json(path)
    return snapshots.select("ts", F.explode("containers").alias("name", "c")).select("ts", "name", "c.*")


def read_responses(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Operation responses; unreadable ones are skipped. A page may show the ``newest`` by file name only."""
    rows = spark.read.schema(f"{schemas.SERVICE_RESPONSE}, {CORRUPT} STRING").option("multiLine", True).option(
        "columnNameOfCorruptRecord", CORRUPT
    ).option("pathGlobFilter", "*.json").json(path)
    named = rows.select("*", F.col("_metadata.file_name").alias("file")).where("file != 'status.json'")
    latest = named if newest is None else named.orderBy(F.col("file").desc()).limit(newest)
    return latest.where(F.col(CORRUPT).isNull()).select("ok", "errors", "completed", F.col("request.targets").alias("targets"), "file")


def read_gallery(spark: SparkSession, path: str) -> DataFrame:
    """Gallery metadata of all users; unreadable files are skipped."""
    rows = spark.read.schema(f"{schemas.GALLERY}, {CORRUPT} STRING").option("multiLine", True).option(
        "columnNameOfCorruptRecord", CORRUPT
    ).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def read_listing(spark: SparkSession, path: str, items_field: str | None = None) -> DataFrame:
    """A landed registry listing as one JSON object per row in ``json``."""
    body = spark.read.text(path, wholetext=True).select(F.col("value").alias("v"))
    array = F.get_json_object("v", f"$.{items_field}") if items_field else F.col("v")
    objects = F.from_json(array, "array<variant>")
    return body.select(F.explode(objects).alias("o")).select(F.to_json("o").alias("json"))


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, size) of the model files below a store; contents are never read.

    A name found in several places keeps its last path.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    inside = F.regexp_extract("path", r"/((?:%s)/.*)$" % "|".join(STORE_FOLDERS), 1)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(name.alias("name"), inside.alias("path"), F.col("length").alias("size")).where(
        (F.col("path") != "") & F.col("name").rlike(STORE_FORMATS)
    )
    return listed.groupBy("name").agg(F.max(F.struct("path", "size")).alias("f")).select("name", "f.path", "f.size")


def store_listing(inventory: DataFrame, registry: DataFrame) -> DataFrame:
    """Inventory with its attributes; an unregistered file is unclassified."""
    return inventory.join(registry, "name", "left").withColumn("nsfw", F.coalesce("nsfw", F.lit("unclassified"))).orderBy("path")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Metric samples; points without a number are dropped."""
    return spark.read.schema(schemas.METRIC_SAMPLE).parquet(path).where(F.col("value").isNotNull() & ~F.isnan("value"))
