"""Driver queries of the operators of this folder, each on its whole table, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreflow.llm import (
    chat, collocations, decontaminate, embeddings, language, licenses, nearcopies, packing, prefixtrie, qualityrules,
    secretscan, substrings, toxicity,
)
from scoreflow.llm.common import table
from scoreflow.llm.oracles import ORACLES  # noqa: F401

QUERIES = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def sha256(value: Column) -> Column:
    return F.sha2(F.encode(value, "UTF-8"), 256)


def id_remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = toxicity.fitted(docs, labels.where(id_remainder(3) != 1))
    return toxicity.scored(docs, scorer).select(
        "doc_id", (id_remainder(3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "neighbours", "evidence",
    )


@query
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_places(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda s: s["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda s: s["first"])).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )


@query
def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, whose texts hold the control strings."""
    own = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), "turn", "role", "text")
    return chat.read_back(chat.formatted(rows.union(own)))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fitted(docs, id_remainder(5) != 0)
    return language.identified(docs, model).select(
        "doc_id", (id_remainder(5) == 0).alias("held_out"), "lang_pred", "score"
    )


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op9_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents"))


@query
def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.found_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        sha256(secretscan.span_text(F.col("base"))).alias("base_sha256"),
        secretscan.span_text(F.col("spans")).alias("spans"),
    )


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query
def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = qualityrules.kept_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *qualityrules.COUNTS, "base_failed", "kept", F.array_join("broken", ",").alias("broken"))


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"), stitch=True)
