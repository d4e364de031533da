"""The corpus pipeline: toxicity, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), decides over all of docs and returns a DataFrame; every one but the last returns the
columns of documents. Null or empty texts stay until packing, where they are an end token alone. Rows are told apart by doc_id and
text: repeated ones are each other's copies. Empty tables and columns beside those of documents come through.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import minhash, packing, pii, suffixes, toxicity
from lodestone.llm.common import free_name, table, written

#: SQL has neither the classifier nor the tokenizer; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores under 0.5. Repeated rows are scored alike, an empty table stays empty."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return toxicity.score_column(docs, model, name=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that with the smallest doc_id, and of its texts and repetitions one. Rows with
    a null doc_id, or without words, belong to no group and stay."""
    found = minhash.near_duplicates(docs, size=5, percent=80).where("n_shingles > 0 and doc_id is not null")
    rows = written(found.groupBy("doc_id", "text_key").agg(F.min("component_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "near-rows")
    first = rows.groupBy("component_id").agg(F.min(F.struct("doc_id", "text_key")).alias("first")).select("first.*").withColumn("is_first", F.lit(True))
    marked = written(rows.join(first, ["doc_id", "text_key"], "left").where("is_first is null or n > 1").select("doc_id", "text_key", F.coalesce("is_first", F.lit(False)).alias("is_first")), "near-marked")
    key = (F.col("doc_id").cast("long"), minhash.text_key())
    d, k = free_name(docs, "near_doc"), free_name(docs, "near_text")
    same = (key[0] == F.col(d)) & (key[1] == F.col(k))
    out = docs.join(marked.select(F.col("doc_id").alias(d), F.col("text_key").alias(k)), same, "left_anti")
    # Rows that repeat the one to stay, text and doc_id, are the exception.
    again = marked.where("is_first").select(F.col("doc_id").alias(d), F.col("text_key").alias(k))
    if again.limit(1).count():
        repeated = docs.join(again, same, "left_semi").withColumn(d, key[0])
        out = out.unionByName(repeated.dropDuplicates([d]).drop(d))
    return out


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words, or of 400 bytes, that occur elsewhere too; n_chars follows the text. Repeated
    rows are each other's repeats, texts of which nothing is left stay, empty."""
    return suffixes.without_passages(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with labels in place of personal data; n_chars follows the text."""
    return pii.redacted(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", cut_repeats),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each on the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
