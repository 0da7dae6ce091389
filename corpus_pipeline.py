"""A corpus pipeline: language, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame that is
written as Parquet and read again. All but the last return the columns of ``documents``; other columns of ``docs`` are
dropped by every stage, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontam, langid, simhash, substring
from quire.llm.shared import staged
from quire.shipping import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of its main language below which a document is rejected.
MIN_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter, and those in which no language has half the text; name a missing language.

    Null and empty texts have no letter, so they go. Rows with a null doc_id are learned from and judged like any
    other; repeated rows stay as often as they are there. Where no row has a language, none is learned and all go.
    """
    docs = docs.select(COLUMNS)
    names, logs = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    out = langid.identify(docs, names, logs, carry=("text", "lang", "source", "n_chars"))
    kept = out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.round("score", 6) >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group: that of the smallest id, rows without an id last.

    Rows are told apart by (doc_id, text), not by doc_id; of rows alike in both one stays, the least of the other columns.
    Null, empty and wordless texts are one group.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    marked = simhash.near_duplicates(keyed.select(F.col("_key").alias("doc_id"), "text"))
    group = marked.select(F.col("doc_id").alias("_key"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_key")).alias("first")
    stays = keyed.select("_key", "doc_id").join(group, "_key").groupBy("component_id").agg(first).select("first._key")
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = keyed.join(stays, "_key").groupBy("_key").agg(F.min(F.struct(*rest, "doc_id", "text")).alias("row"))
    return one.select("row.*").select(COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that stand elsewhere too, as operator 3 does: in every place, the first as well.

    A text without one stays as it is, to the byte; a text that is nothing but such passages goes. Null and empty texts
    and rows with a null doc_id stay. Rows that repeat each other would lose all they share: the stage before leaves none.
    """
    out = substring.remove_repeats(docs.select(COLUMNS), carry=("text", "lang", "source", "n_chars"))
    cut = F.col("n_removed") > 0
    out = out.where((F.col("n_removed") < F.col("n_words")) | ~cut)
    out = out.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the rows that hold a benchmark item.

    Rows are told apart by (doc_id, text), so a clean row stays though it shares its id with one that goes; rows without
    an id go and stay like others. Null and empty texts hold no item. Without items all rows stay.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    gone = decontam.contaminated(keyed.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keyed.join(gone.withColumnRenamed("doc_id", "_key"), "_key", "left_anti").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, and decode it again: doc_id, the token ids, their number, and digests of ids and decoded text.

    Null and empty texts have no tokens; a row comes out for each row, repeated ones and those without an id too.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontaminate), ("bpe", tokenize)]
#: SQL cannot express fingerprint components, mixture inference or byte-pair merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
