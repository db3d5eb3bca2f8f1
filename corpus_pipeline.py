"""A cleaning pipeline over a corpus: each stage reads what the one before it kept, and writes its own.

Toxic documents go; of each group of near copies the document with the smallest id stays; documents that
hold a benchmark item go; secrets are masked; what is left is packed into sequences. All but the last
stage return the columns of the documents. Decisions act on rows by their texts, so rows without an id and
repeated ones are treated like others; of repeated rows with words one stays.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.llm import decontaminate, jaccard_join, packing, secret_scan, toxicity
from filigree.llm.common import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.toxicity(model, F.col("text"), spark) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secret_scan.redact(docs, secret_scan.scan(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic), ("near copies", drop_near_copies), ("decontamination", drop_contaminated),
    ("secrets", mask_secrets), ("packing", pack),
]
#: The scores of trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir))
    return docs
