"""The corpus pipeline: toxicity, near duplicates, secrets, packing; each stage is written and read again.

All stages but the last keep the columns they are given, of any names; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.inputs import free_name
from strandline.llm.near_dedup import near_duplicates
from strandline.llm.packing import best_fit_pack
from strandline.llm.secrets import mask_live_secrets
from strandline.llm.skew import split_rows
from strandline.llm.toxicity import keep_clean
from strandline.operators.components import cut_lineage, shared_folder
from strandline.shipping import ship_package


#: Stands for a doc_id that is null.
NO_ID = -(1 << 62)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, as they are; null and empty texts are not, long ones are judged whole, equal texts alike."""
    ship_package(spark)
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates; null, empty and blank texts are alone and stay.

    A row is named by its doc_id and text: equal rows stay once, different texts of one doc_id, or
    without doc_id, are documents of their own. Texts are shuffled only where a row repeats, as long as
    the names of the rows that go fit a broadcast.
    """
    ship_package(spark)
    names = [free_name(docs, n) for n in ("_doc", "_text")]
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    named = docs.withColumns({names[0]: doc, names[1]: F.xxhash64(F.col("text").cast("string"))})
    judged = near_duplicates(docs).select(doc.alias(names[0]), F.col("text_key").alias(names[1]), "kept")
    # rows that go or that are there more than once
    other = cut_lineage(judged.groupBy(*names).agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("not kept or n > 1").select(*names, F.col("kept").alias(free_name(docs, "_kept"))))
    touched, rest = split_rows(named, other, names)
    again = touched.where(F.col(free_name(docs, "_kept"))).dropDuplicates(names)
    return rest.select(docs.columns).unionByName(again.select(docs.columns))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, live-looking secrets masked and n_chars, where there is one, counted anew where text changed; repeated rows repeat."""
    before = free_name(docs, "_before")
    masked = mask_live_secrets(docs.withColumn(before, F.xxhash64("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        masked = masked.withColumn("n_chars", F.when(F.xxhash64("text") != F.col(before), F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens; null and empty texts are one end token, repeated rows repeat."""
    ship_package(spark)
    return best_fit_pack(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED)


#: Bytes of words that a packing worker remembers: fewer than by itself, as the executors still hold what earlier stages took.
REMEMBERED = 24 << 20

STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs


#: Tokenisation, learning and MinHash are beyond SQL.
ORACLE_SQL = None
