"""Sections, titles and the document table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import file_name, strip, title_case

from .cleanup import DOC, ORDER
from .sequence import until

_HEAD = ("chapter_title", "heading")


def section_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks with ``section_ix``: a title or heading opens a section; blocks before the first are in section 0."""
    head = F.coalesce((F.col("block_kind") == "text") & F.col("type").isin(*_HEAD), F.lit(False))
    return blocks.withColumn("is_head", head).withColumn("section_ix", F.sum(F.col("is_head").cast("int")).over(until(DOC, ORDER)).cast("int"))


def sections(sectioned: DataFrame) -> DataFrame:
    """(doc_id, section_ix, title, level, children): those with a title or children."""
    first = F.min_by(F.struct(F.when(F.col("is_head"), strip(F.col("text"))).otherwise("").alias("title"), F.when(F.col("is_head") & (F.col("type") == "heading"), 2).otherwise(1).alias("level")), "order_key")
    out = sectioned.groupBy("doc_id", "section_ix").agg(first.alias("s"), F.count("*").alias("children"))
    return out.select("doc_id", "section_ix", "s.title", "s.level", "children").where("title <> '' or children > 0")


def title_key(stem: Column) -> Column:
    """A file stem as a title would say it: leading numbers and marks cut, underscores spaces, lower case."""
    return F.lower(strip(F.replace(F.regexp_replace(stem, r"^[\d_\-\s]+", ""), F.lit("_"), F.lit(" "))))


def title_variants(key: Column) -> Column:
    """The key, its plural and its singular; none empty."""
    single = F.regexp_replace(key, "s+$", "")
    return F.array_except(F.array_distinct(F.array(key, F.concat(key, F.lit("s")), single, F.concat(single, F.lit("s")))), F.array(F.lit("")))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def guess_titles(blocks: DataFrame, stems: DataFrame) -> DataFrame:
    """(doc_id, title) for ``stems(doc_id, stem)``: a short heading that is the file's name, a chapter title before a
    heading; else a short chapter title; else the file's name in title case."""
    heads = blocks.where((F.col("block_kind") == "text") & F.col("type").isin(*_HEAD)).select("doc_id", "order_key", "type", strip(F.col("text")).alias("t"))
    keyed = stems.withColumn("key", title_key(F.col("stem")))
    j = heads.join(keyed, "doc_id").withColumn("named", F.array_contains(title_variants(F.col("key")), F.lower("t")) & (F.length("t") <= 20))
    chapter = F.col("type") == "chapter_title"
    rank = F.when(F.col("named") & chapter, 0).when(F.col("named"), 1).when(chapter & (F.length("t") <= 40), 2)
    best = j.withColumn("rank", rank).where("rank is not null").groupBy("doc_id").agg(F.min_by("t", F.struct("rank", "order_key")).alias("t"))
    fallback = F.when(F.col("key") != "", title_case(F.col("key"))).when(F.col("stem") != "", F.col("stem")).otherwise("Document")
    return keyed.join(best, "doc_id", "left").select("doc_id", F.coalesce("t", fallback).alias("title"))


def documents(blocks: DataFrame, stems: DataFrame) -> DataFrame:
    """``documents(doc_id, title, meta)``."""
    return guess_titles(blocks, stems).withColumn("meta", F.create_map(F.lit("source"), F.col("doc_id")))
