"""Corpus preparation: stages over ``documents``, each written as Parquet and read by the next.

1. Language ID: a network learned from the stage's own rows that carry a tag; rows without a letter, or
   whose language is unsure, go.
2. MinHash near-dedup: the document of smallest id of each group of near copies (shingles of five words) stays.
3. Benchmark decontamination: hit spans are cut out; a document that is mostly benchmark text goes.
4. Secret scans: every span found is masked.
5. Packing: token pieces with their sequence and offset.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.llm import decontaminate, language, nearcopies, packing, secretscan
from scoreflow.llm.common import stored, table

#: SQL for the rows of ``run``; tokenizers and trained models are beyond SQL.
ORACLE_SQL = None


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs, language.fitted(docs, F.lit(True)))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.without_copies(docs, k=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identified),
    ("MinHash near-dedup", without_near_copies),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
