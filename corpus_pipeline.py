"""The corpus pipeline over ``documents``: every stage reads what the one before it wrote.

1. quality classifier: documents that score under 0.3 go;
2. SimHash near-dedup: one document of each group stays (4-word shingles, at most 4 bits);
3. substring dedup: words in 35-word windows that occur elsewhere go;
4. secret scans: secrets are replaced;
5. packing: the kept texts as pieces of sequences of at most 2048 ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from consign.llm import doubling, packing, quality, secrets, simhash
from consign.llm.common import scratch_table, ship_package, table

ORACLE_SQL = None  # trained models and byte-pair packing are beyond SQL; tests compare with brute force

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return simhash.drop_near_duplicates(docs, shingle=4, radius=4)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return doubling.remove(docs, size=35)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.scan(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack(docs, TOKENIZER, length=2048, end_id=1)


STAGES = [("quality classifier", quality_filter), ("simhash near-dedup", near_copies),
          ("substring dedup", repeated_passages), ("secret scans", secret_spans), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs, _ = scratch_table(stage(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
