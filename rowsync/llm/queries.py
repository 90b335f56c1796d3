"""The registered queries: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, contamination, embeddings, fim, langid, lines, minhash, prefix_trie, secrets, shards, suffixes, toxicity, urls
from .common import ship, table
from .sql import ORACLE  # noqa: F401  (read by the entry module)


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary, a default for the path parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return suffixes.repeats_digest(table(spark, sf_dir, "documents"))


def op7_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return contamination.contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.kd_shards(table(spark, sf_dir, "documents"))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), urls.rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return fim.fim_digest(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return lines.line_digest(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_secrets, op4_embeddings, op5_language, op6_suffixes,
                                   op7_contamination, op8_minhash, op9_shards, op10_urls, op11_conversation_trie, op12_fill_in_middle,
                                   op13_line_dedup)}
