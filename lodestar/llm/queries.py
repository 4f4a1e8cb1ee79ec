"""The queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship, spread
from . import byte_bpe, chosen_path, exact_dedup, lm_score, merkle, order_minhash, packing, periodic_runs, quality, secret_scan, substring_dedup, suffix_dedup, token_coder


def tokenizer(name: str) -> str:
    """A public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return lm_score.score(_documents(spark, sf_dir), held=held, order=3)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_documents(spark, sf_dir)))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(_documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.tiktoken"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages that repeat, by document; documents without one have no row."""
    return substring_dedup.whole_passages(_documents(spark, sf_dir))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.similar_texts(_documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_coder.round_trip(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its probabilities, and whether it is kept."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(_documents(spark, sf_dir), labels)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    edited = periodic_runs.made_periodic(F.col("doc_id"), F.col("text"))
    return periodic_runs.digest(periodic_runs.periodic_runs(docs.select("doc_id", edited.alias("text"))))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest, and what a presented table with some n_chars raised by one is told by it."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.verified(merkle.manifest(merkle.leaves(_documents(spark, sf_dir), {"n_chars": tampered})))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.repeated_bytes(_documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_secret_scan, op3_order_minhash, op4_best_fit_packing, op5_exact_dedup, op6_byte_bpe, op7_substring_dedup, op8_ngram_jaccard_join, op9_token_files, op10_quality_classifier, op11_periodic_runs, op12_merkle_manifest, op13_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
                   doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    }
