"""A training-corpus pipeline over documents: five stages, each an operator of tallyrook.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.llm import bpe, jaccard_join, mixing, secret_scan, toxicity
from tallyrook.llm.common import Scratch
from tallyrook.llm.queries import tokenizer_path

#: Near duplicates here share 80% of their five-word shingles.
NEAR = jaccard_join.Join(width=5, num=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learnt from the labels, predicts toxic go.

    Null and empty texts are scored as empty and stay; equal texts share their fate; a table of any
    size, none included, keeps its columns, whatever their names.
    """
    grammar = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, grammar).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Null, empty and blank texts belong to no group and stay, one for each id; rows that repeat id and
    text are one. Without ids, a group with ids keeps those, and else one of each different text.
    """
    return jaccard_join.keep_first(docs, NEAR).select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text where that changes.

    No row goes. Null and empty texts stay as they are; repeated rows change alike.
    """
    clean = secret_scan.redact(secret_scan.scan_secrets(docs))
    changed = F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", changed).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight; a document that the mix takes twice is two rows.

    Null is a source of its own; null and empty texts have size 0 and come as often as their source's
    rate says, or not at all if it has no words; rows that repeat each count.
    """
    return mixing.take(docs).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids, little-endian unsigned 32-bit integers, a row for each document.

    Null and empty texts have no ids; ids of documents may be null or repeat.
    """
    return bpe.encode_decode(docs, tokenizer_path()).select(F.col("_id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("secrets", mask_secrets), ("mix", mix), ("tokens", tokenize)]
#: Learnt weights and iterated joins have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written as Parquet and read again by the next."""
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
