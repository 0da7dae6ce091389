"""Coverage, statistics and inspection of documents: aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import duration, percent, token_estimate, words_count

_EQ = r"(?i)\.(wmf|emf)$"


def source_counts(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, src_tables, src_images, src_frames): what the runs of a document refer to."""
    r = paragraphs.select("doc_id", F.explode("runs").alias("r"))
    return r.groupBy("doc_id").agg(F.count_if(F.size("r.grid") > 0).alias("src_tables"), F.count_if(F.col("r.image_uri") != "").alias("src_images"), F.count_if(F.col("r.textframe_story") != "").alias("src_frames"))


def output_counts(blocks: DataFrame) -> DataFrame:
    """(doc_id, tables, equations, equations_resolved, figures, boxes) of the output."""
    eq = F.filter(F.coalesce("runs", F.array()), lambda r: r["is_image"] & r["original_ref"].rlike(_EQ))
    b = blocks.withColumn("eq", eq).withColumn("done", F.filter("eq", lambda r: (r["src"] != "") | (r["latex"] != "")))
    text = F.col("block_kind") == "text"
    return b.groupBy("doc_id").agg(
        F.count_if(F.col("block_kind") == "table").alias("tables"), F.sum(F.when(text, F.size("eq")).otherwise(0)).alias("equations"), F.sum(F.when(text, F.size("done")).otherwise(0)).alias("equations_resolved"),
        F.count_if((F.col("block_kind") == "image") & F.col("original_ref").startswith("pdf:")).alias("figures"), F.count_distinct(F.when(text & (F.col("box_group") != 0), F.col("box_group"))).alias("boxes"),
    )


def coverage(paragraphs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Source against output, one row a document."""
    j = source_counts(paragraphs).join(output_counts(blocks), "doc_id", "full").na.fill(0)
    return j.withColumns({"tables_pct": percent(F.col("tables"), F.col("src_tables")), "equations_pct": percent(F.col("equations_resolved"), F.col("equations"))})


def statistics(blocks: DataFrame, sections: DataFrame | None = None, assets: DataFrame | None = None, source_pages: DataFrame | None = None, seconds: float | None = None) -> DataFrame:
    """One row a document: characters, words, blocks, equations, tables, placed images, pages, a token estimate."""
    text = F.col("block_kind") == "text"
    runs = F.filter(F.coalesce("runs", F.array()), lambda r: r["is_image"])
    b = blocks.withColumns({"_img": F.size(runs), "_ok": F.size(F.filter(runs, lambda r: (r["src"] != "") | (r["latex"] != "")))})
    s = b.groupBy("doc_id").agg(
        F.sum(F.when(text, F.length("text")).otherwise(0)).alias("characters"), F.sum(F.when(text, words_count(F.col("text"))).otherwise(0)).alias("words"), F.count_if(text).alias("text_blocks"),
        F.sum(F.when(text, F.col("_img")).otherwise(0)).alias("equations"), F.count_if(F.col("block_kind") == "table").alias("tables"),
        F.count_if((F.col("block_kind") == "image") & (F.col("src") != "")).alias("figures"), F.sum(F.when(text, F.col("_ok")).otherwise(0)).alias("inline_assets"), F.count_distinct("page").alias("block_pages"),
    )
    if assets is not None:
        s = s.join(assets.groupBy("doc_id").agg(F.count_if(F.col("found") & (F.col("output_rel") != "")).alias("linked"), F.count("*").alias("assets_total")), "doc_id", "left")
    else:
        s = s.withColumns({"linked": F.lit(0), "assets_total": F.lit(0)})
    s = s.join(sections.groupBy("doc_id").agg(F.count("*").alias("sections")), "doc_id", "left") if sections is not None else s.withColumn("sections", F.lit(0))
    s = s.join(source_pages.select("doc_id", "source_pages"), "doc_id", "left") if source_pages is not None else s.withColumn("source_pages", F.lit(0))
    s = s.na.fill(0)
    out = s.withColumns({
        "tokens": token_estimate(F.col("characters")), "images_placed": F.greatest("linked", "figures") + F.col("inline_assets"),
        "pages": F.when(F.col("source_pages") > 0, F.col("source_pages")).otherwise(F.col("block_pages")),
    })
    if seconds is not None:
        out = out.withColumns({"elapsed_seconds": F.lit(round(seconds, 3)), "elapsed_human": duration(F.lit(seconds))})
    return out.drop("linked", "figures", "inline_assets", "block_pages", "source_pages")


def inspect(parts: DataFrame, pages: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a package: stories, spreads, pages, frames, and whether it is threaded or has double columns."""
    p = parts.groupBy("doc_id").agg(F.count_if(F.col("part_name").rlike(r"^Stories/Story_.*\.xml$")).alias("stories"), F.count_if(F.col("part_name").rlike(r"^Spreads/Spread_.*\.xml$")).alias("spreads"))
    g = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    f = frames.groupBy("doc_id").agg(F.count("*").alias("frames"), F.bool_or((F.col("kind") == "text") & ((F.col("next_frame") != "") | (F.col("prev_frame") != ""))).alias("threaded"), F.bool_or(F.col("column_count") > 1).alias("double_column_frames"))
    return p.join(g, "doc_id", "left").join(f, "doc_id", "left").na.fill(0).na.fill(False)


def distinct_assets(assets: DataFrame) -> DataFrame:
    """Assets in the order of their first use."""
    return assets.orderBy("doc_id", "first_ix", "original_ref")


def batch_code(results: DataFrame) -> DataFrame:
    """(rc): the largest return code; 1 if there are none."""
    return results.agg(F.coalesce(F.max("rc"), F.lit(1)).alias("rc"))
