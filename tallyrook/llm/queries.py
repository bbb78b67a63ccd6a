"""The operators as queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, conversation_trie, decontaminate, hamming_topk, jaccard_join, mixing, oracles, pii, quality_rules, resample, secret_scan, sharding, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(secret_scan.scan_secrets(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    grammar = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.report(toxicity.score(docs, grammar))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(quality_rules.judge_quality(_table(spark, sf_dir, "documents")))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(jaccard_join.jaccard_groups(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.report(url_filter.filter_urls(_table(spark, sf_dir, "pages").select("page_id", "url")))


def op7_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id is divisible by 100."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return hamming_topk.report(hamming_topk.nearest_codes(vectors, vectors.where("vec_id % 100 = 0")))


def tokenizer_path() -> str:
    """The file of the tokenizer that op8 is held against."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(bpe.encode_decode(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.report(sharding.shard_documents(_table(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(mixing.mix_sources(_table(spark, sf_dir, "documents")))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.find_overlaps(docs, _table(spark, sf_dir, "benchmark")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample.report(resample.draw(resample.weigh(docs, _table(spark, sf_dir, "benchmark")).drop("text")))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.report(conversation_trie.conversation_trie(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Query]:
    found = [op1_secret_scan, op2_toxicity, op3_pii, op4_quality_rules, op5_jaccard_join, op6_url_filter, op7_hamming_topk, op8_bpe, op9_sharding, op10_mixing]
    found += [op11_decontaminate, op12_resample, op13_conversation_trie]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
