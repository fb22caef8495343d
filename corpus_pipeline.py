"""From raw documents to token ids: rules, exact and near dedup, mixing by source, encoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueline.llm.bpe import bpe_round_trip
from cueline.llm.exact_dedup import drop_exact_copies
from cueline.llm.near_dedup import keep_one_of_each
from cueline.llm.quality_rules import keep_good
from cueline.llm.shared import forget, prepare, stored
from cueline.llm.source_mixing import repeat_by_mix

TOKENIZER = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id."""
    prepare(spark)
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    prepare(spark)
    return keep_one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, or not at all."""
    prepare(spark)
    return repeat_by_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, their number, and a digest of the text they decode to."""
    prepare(spark)
    return bpe_round_trip(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mixed), ("bpe_encoding", encoded)]
#: Near duplicates, the hashed ratio and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage-{k}-{name}")
            forget(before)
    return docs
