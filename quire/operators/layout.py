"""Page layout from tables of words, blocks and bands: columns, figures, openers and finishers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import MobileProfile
from quire.functions.html import esc

from .sequence import gap_sessions, renumber

PAGE = ["doc_id", "page"]
FIGURES_PER_PAGE = 20


def gutters(words: DataFrame, pages: DataFrame, text_blocks: DataFrame, step: float = 2.0) -> DataFrame:
    """(doc_id, page, gutter) of two-column pages.

    ``words(x0, x1)`` and ``text_blocks(x0, x1)`` lie on ``pages(width)``. The gutter is the mean of the places between
    42 % and 58 % of the width that fewest words cross. A page has two columns if it has 40 words and 6 blocks, 20
    words and 3 blocks on either side, and at most a fifth of its blocks cross.
    """
    xs = pages.select(*PAGE, "width", F.explode(F.sequence(F.lit(0), F.floor(F.col("width") * 0.16 / step).cast("int"))).alias("k")).withColumn("at", F.col("width") * 0.42 + F.col("k") * step)
    crossing = xs.join(words, PAGE).groupBy(*PAGE, "at").agg(F.count_if((F.col("x0") < F.col("at")) & (F.col("x1") > F.col("at"))).alias("n"))
    low = crossing.withColumn("least", F.min("n").over(W.partitionBy(*PAGE))).where("n = least").groupBy(*PAGE).agg(F.avg("at").alias("gutter"))
    side = lambda df, name: df.join(low, PAGE).groupBy(*PAGE).agg(F.count("*").alias(name), F.count_if(F.col("x1") <= F.col("gutter")).alias(name + "_l"), F.count_if(F.col("x0") >= F.col("gutter")).alias(name + "_r"))
    both = low.join(side(words, "w"), PAGE).join(side(text_blocks, "b"), PAGE)
    two = "w >= 40 and b >= 6 and w_l >= 20 and w_r >= 20 and b_l >= 3 and b_r >= 3 and (b - b_l - b_r) <= b * 0.2"
    return both.where(two).select(*PAGE, "gutter")


def column_clips(pages: DataFrame, gutter: DataFrame, overlap: float = 20.0) -> DataFrame:
    """(doc_id, page, clip_ix, x0, x1): a page's columns, overlapping a little; the first page and others stay whole."""
    p = pages.join(gutter, PAGE, "left")
    split = F.col("gutter").isNotNull() & (F.col("page") > 0)
    whole = F.array(F.struct(F.lit(0.0).alias("x0"), F.col("width").cast("double").alias("x1")))
    parts = F.array(F.struct(F.lit(0.0).alias("x0"), (F.col("gutter") + overlap / 2).alias("x1")), F.struct((F.col("gutter") - overlap / 2).alias("x0"), F.col("width").cast("double").alias("x1")))
    return p.select(*PAGE, F.posexplode(F.when(split, parts).otherwise(whole)).alias("clip_ix", "c")).select(*PAGE, "clip_ix", "c.*")


def figure_bands(rows: DataFrame, gap: float = 18.0, least_height: float = 20.0, max_density: float = 0.5, max_colour: float = 0.25) -> DataFrame:
    """(doc_id, page, col, band_ix, y0, y1): runs of figure rows, small gaps bridged, that look like a drawing.

    ``rows(doc_id, page, col, y, is_figure, density, colour)`` describe raster rows.
    """
    key = [*PAGE, "col"]
    s = gap_sessions(rows.where("is_figure"), key, ["y"], F.col("y"), gap, "band_ix")
    bands = s.groupBy(*key, "band_ix").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("density").alias("density"), F.avg("colour").alias("colour"))
    return bands.where((F.col("y1") - F.col("y0") >= least_height) & (F.col("density") < max_density) & (F.col("colour") < max_colour))


def top_bands(bands: DataFrame, most: int = FIGURES_PER_PAGE) -> DataFrame:
    """The first bands of a page by rounded position: the reports keep ``most`` of them."""
    return renumber(bands, PAGE, [F.bround("y0"), "col", "band_ix"], "visual_ix").where(F.col("visual_ix") < most)


def opener(pdf_blocks: DataFrame, pages: DataFrame, least: float = 60.0) -> DataFrame:
    """(doc_id, page, y0, y1): the first page's band above its first long text, or its upper half."""
    first = pages.where("page = 0").select("doc_id", "page", "height")
    above = pdf_blocks.where("page = 0").groupBy("doc_id").agg(F.min(F.when(F.length("text") > 120, F.col("y0"))).alias("limit"))
    out = first.join(above, "doc_id", "left").withColumn("y1", F.coalesce("limit", F.col("height") * 0.5))
    return out.where(F.col("y1") >= least).select("doc_id", "page", F.lit(0.0).alias("y0"), "y1")


def finishers(pdf_blocks: DataFrame, pages: DataFrame, phrase: str, above: float = 8.0) -> DataFrame:
    """(doc_id, page, y0, y1): pages that hold the phrase, from a little above it."""
    hits = pdf_blocks.where(F.contains(F.lower("text"), F.lit(phrase.lower()))).groupBy(*PAGE).agg(F.min("y0").alias("y"))
    return hits.join(pages, PAGE).select(*PAGE, F.greatest(F.lit(0.0), F.col("y") - above).alias("y0"), F.col("height").cast("double").alias("y1"))


def figure_pages(bands: DataFrame, finisher: DataFrame) -> DataFrame:
    """Bands of pages that are neither the first nor a finisher's."""
    return bands.where("page > 0").join(finisher.select(*PAGE).distinct(), PAGE, "left_anti")


def visual_anchors(visuals: DataFrame, pdf_blocks: DataFrame) -> DataFrame:
    """``visuals`` with the nearest text above and below that shares some width with them."""
    t = pdf_blocks.select(*PAGE, F.col("x0").alias("tx0"), F.col("x1").alias("tx1"), F.col("y0").alias("ty0"), F.col("y1").alias("ty1"), "text")
    j = visuals.join(t, PAGE, "left").withColumn("over", (F.col("tx0") < F.col("x1")) & (F.col("tx1") > F.col("x0")))
    own = [c for c in visuals.columns]
    return j.groupBy(*own).agg(
        F.coalesce(F.max_by("text", F.when(F.col("over") & (F.col("ty1") <= F.col("y0")), F.col("ty1"))), F.lit("")).alias("anchor_before"),
        F.coalesce(F.min_by("text", F.when(F.col("over") & (F.col("ty0") >= F.col("y1")), F.col("ty0"))), F.lit("")).alias("anchor_after"),
    )


def facsimile_tiles(clips: DataFrame, pages: DataFrame, profile: MobileProfile | None = None, least: float = 8.0) -> DataFrame:
    """(doc_id, page, clip_ix, src, x0, x1, height, width_pt, height_pt): what each clip becomes on a page of the profile's width.

    Clips under ``least`` points wide or high give no tile; the others keep their numbers.
    """
    width = (profile or MobileProfile()).page_width * 72 / 96
    src = F.format_string("images/page_%03d_%d.jpg", (F.col("page") + 1).cast("int"), (F.col("clip_ix") + 1).cast("int"))
    t = clips.join(pages.select(*PAGE, F.col("height").cast("double").alias("height")), PAGE)
    t = t.where((F.col("x1") - F.col("x0") >= least) & (F.col("height") >= least))
    return t.select(*PAGE, "clip_ix", src.alias("src"), "x0", "x1", "height", F.lit(float(width)).alias("width_pt"), (F.col("height") * (F.lit(float(width)) / (F.col("x1") - F.col("x0")))).alias("height_pt"))


def facsimile_pages(docs: DataFrame, tiles: DataFrame, profile: MobileProfile | None = None) -> DataFrame:
    """(doc_id, html): a document's tiles in order, as one page. A document without tiles has an empty body."""
    tag = lambda t, i: F.concat(F.lit('<img src="'), esc(t["src"]), F.lit('" alt="page tile '), (i + 1).cast("string"), F.lit('" loading="lazy">'))
    per = tiles.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "clip_ix", "src"))), tag), "\n").alias("body"))
    start = f'<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width={(profile or MobileProfile()).page_width}, initial-scale=1"><title>Facsimile</title><link rel="stylesheet" href="css/styles.css"></head><body>'
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.concat(F.lit(start), F.coalesce("body", F.lit("")), F.lit("</body></html>")).alias("html"))
