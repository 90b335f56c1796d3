"""A training-data pipeline over ``documents``, one dealt operator a stage.

Each stage is a function of (spark, docs, sf_dir); ``run`` writes what a stage
returns as Parquet under the shared checkpoint folder and reads it again as the
next one's ``docs``. All stages but the last return the columns of ``docs``.

- language ID: rejects texts without a letter, and those that the network is less
  sure of than of any labelled text of their length that it gets right; the network
  learns from rows outside the held-out fold that have a language, the least scores
  come from all labelled rows of that fold. A document whose language the network
  confirms stays. Where nothing could be learned, every text with a letter stays.
- MinHash near-dedup: one row of each group of near duplicates stays, of the
  smallest id; documents without words stay. Of rows that repeat an id one stays,
  with the text of least hash among them (any of the rows with that text, should
  their other columns differ); rows of null id all stay.
- benchmark decontamination: documents that hold a benchmark window go.
- secret scans: every span is replaced by a mark; all documents stay.
- BPE: n_tokens and digests of the ids and of the decoded text, as in op2.

The network of the first stage has no SQL form, so ``ORACLE_SQL`` is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowsync.llm import bpe, contamination, langid, minhash, secrets
from rowsync.llm.common import crc_mod, ship, table, written
from rowsync.llm.queries import tokenizer_path

ORACLE_SQL = None


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    held = crc_mod("doc_id", 3) == 1
    model = langid.fit_languages(docs.filter(~held))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    least = langid.least_scores(docs.filter(held), model)
    judged = langid.predict_languages(docs.withColumns({"_lang": F.col("lang"), "_least": langid.least_score(least)}), model, [*docs.columns, "_lang", "_least"])
    stays = F.col("lang_pred").eqNullSafe(F.col("_lang")) | (F.col("score") >= F.col("_least"))
    return judged.filter((F.col("lang_pred") != langid.UNKNOWN) & stays).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    kept = minhash.near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    named = docs.withColumn("_text", F.xxhash64("text"))
    # rows that repeat an id: the text of the least hash, once
    texts = docs.groupBy(F.col("doc_id").alias("_id")).agg(F.min(F.xxhash64("text")).alias("_key")).join(kept, "_id")
    mine = named.join(texts, (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_key")))
    mine = mine.dropDuplicates(["doc_id"]).select(*docs.columns)
    return mine.unionByName(docs.filter("doc_id IS NULL"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    found = contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"), docs.columns)
    return found.filter(F.size("runs") == 0).select(*docs.columns)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.bpe_digest(docs, tokenizer_path())


STAGES = [("language_id", language_stage), ("minhash_near_dedup", near_duplicate_stage),
          ("benchmark_decontamination", decontamination_stage), ("secret_scans", secret_stage), ("bpe", bpe_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
