"""The corpus pipeline: documents in, token ids out, each with its place in the training order.

Five stages, each over everything that the stage before it kept. Each stage's result is written as Parquet in the cluster's
shared folder and read again, so a lost executor costs one stage's work at most.

1. quality_rules drops the documents that the cascade rejects.
2. line_dedup deletes passages that an earlier document has. Documents of which no word is left go; the others keep the
   rest of their text, however small a share it is.
3. near_duplicates keeps one document of each SimHash group, the first.
4. mix draws documents to the source weights, whole, some more than once, in training order.
5. tokens encodes each text. Files are read in any order, so each row gets its place in what mix wrote: sorting by order_file
   and order_row gives the training order, and tells the copies of a document apart.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm import curriculum_mix, line_align, matrix_bpe, quality_cascade, simhash_trie
from sluiceway.session import configure, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return quality_cascade.judge(docs).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    left = line_align.dedup(docs)
    return left.where(F.col("n_words") > F.col("deleted_words")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return simhash_trie.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    configure(spark)
    return curriculum_mix.mix(docs).select(*COLUMNS)


def written_order() -> tuple[Column, Column]:
    """(order_file, order_row) of a row of a sorted result that was written and is read again. Spark numbers its files in the order
    of the partitions; the numbers are padded, so that they sort as text. Other files go by name."""
    name = F.col("_metadata.file_name")
    task, file = (F.regexp_extract(name, r"^part-([0-9]+)-.*-c([0-9]+)\.", k) for k in (1, 2))
    padded = F.concat_ws("-", F.lpad(task, 10, "0"), F.lpad(file, 10, "0"))
    return F.when(task == "", name).otherwise(padded).alias("order_file"), F.col("_metadata.row_index").alias("order_row")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` as read from files: their order is that of the training run."""
    configure(spark)
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    placed = docs.select("doc_id", "source", "text", *written_order())
    encoded = matrix_bpe.encode(placed, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, outputs=outputs)
    return encoded.select("doc_id", "source", "order_file", "order_row", *outputs)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens),
]
# Patience diff and trie joins are beyond SQL; tests/llm/test_pipeline.py checks the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
