"""Registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of ``documents`` that hold an item of ``benchmark``: one row a pair, with score and place."""
    from .decontam import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers over ``documents``."""
    from .quality import judge

    return judge(_table(spark, sf_dir, "documents")).drop("lang", "source")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` outside every repeated 35-word window; a digest of what is kept."""
    from .substring import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of ``documents`` by mixture inference, learned from the rows that are not held out."""
    from .langid import predict_held_out

    return predict_held_out(_table(spark, sf_dir, "documents")).drop("proportions")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of ``documents`` and the text decoded from them, as digests."""
    import public_tokenizers

    from .bpe import round_trip

    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of ``documents`` outside every 50-byte string of an earlier document; a digest of what is kept."""
    from .suffix import remove_earlier_strings

    out = remove_earlier_strings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of ``documents`` and their near-duplicate components."""
    from .simhash import near_duplicates

    out = near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` written to WARC archives with dictionaries, and read back."""
    from .warc import archive_and_read

    out = archive_and_read(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of ``documents``, fitted on ``labels``."""
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of ``pages`` by rules and host reputation; a label's doc_id names the page of that id."""
    from .urls import filter_urls

    labels = _table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return filter_urls(_table(spark, sf_dir, "pages"), outcomes).drop("chance_clean")


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_quality_rules, op3_substring_dedup, op4_language_id, op5_bpe_round_trip, op6_suffix_array_dedup, op7_simhash_near_dedup, op8_warc, op9_toxicity, op10_url_filters)
}
SQL = {"op3_substring_dedup": sql.SUBSTRING_DEDUP, "op6_suffix_array_dedup": sql.SUFFIX_DEDUP, "op8_warc": sql.WARC, "op10_url_filters": sql.URL_FILTERS}
