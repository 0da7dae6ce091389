"""Whole jobs: convert, inspect, validate, batch. Many packages in one job, each kept apart by doc_id."""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.config import ConversionConfig, MobileProfile
from quire.functions.text import file_name
from quire.operators import align, cleanup, coverage, expand, grouping, lookup, order, qa, render, sections
from quire.sources import idml, packages, sinks
from quire.sources.sinks import guard_output  # noqa: F401
from quire.staging import cut
from quire.streaming.events import Progress


@dataclass
class Conversion:
    """The tables of a conversion. Those that others use are written once; the rest are lazy."""

    parts: DataFrame
    pages: DataFrame
    frames: DataFrame
    paragraphs: DataFrame
    blocks: DataFrame
    sections: DataFrame
    titles: DataFrame
    html: DataFrame
    assets: DataFrame
    coverage: DataFrame
    stats: DataFrame
    qa: DataFrame


def convert(parts: DataFrame, config: ConversionConfig | None = None, links: DataFrame | None = None, equations: DataFrame | None = None, payloads: DataFrame | None = None, outcomes: DataFrame | None = None, pdf_blocks: DataFrame | None = None, visuals: DataFrame | None = None, progress: Progress | None = None) -> Conversion:
    """``parts`` of any number of packages to all output tables.

    ``links(doc_id, name, path)``, ``equations``, ``payloads(doc_id, original_ref, content)``, ``outcomes(path, ok)``,
    ``pdf_blocks`` and ``visuals`` are optional inputs; without them the steps that need them do nothing. ``progress``
    hears of each step that has been computed.
    """
    say = (progress or Progress()).emit
    config = config or ConversionConfig()
    spark = parts.sparkSession
    good = parts.where("part_name <> '!error'")
    pages, frames = (cut(t, n) for t, n in zip(idml.layout(good), ("pages", "frames")))
    paragraphs = cut(idml.paragraphs(good, config.compat), "paragraphs")
    say("parse", "stories and spreads read", progress=0.3)
    placed = order.place(frames, config.reading_order, idml.story_order(good))
    if links is None:
        links = spark.createDataFrame([], "doc_id string, name string, path string")
    if equations is None:
        equations = spark.createDataFrame([], "basename string, latex string, display boolean")
    inline = paragraphs.select("doc_id", F.explode("runs").alias("r")).where("r.image_uri <> ''").select("doc_id", F.col("r.image_uri").alias("link_uri"), F.lit(1 << 30).alias("first_ix"))
    refs = frames.where("kind = 'image'").select("doc_id", "link_uri", F.col("frame_ix").alias("first_ix")).unionByName(inline)
    assets = cut(lookup.resolve_assets(refs, links, outcomes=outcomes), "assets")
    blocks = cut(expand.reconstruct(placed, paragraphs, assets if config.convert_assets else None), "blocks")
    blocks = lookup.inline_images(blocks, equations, assets, payloads, dpi=config.eq_render_dpi)
    blocks = cut(cleanup.drop_layout_panels(cleanup.clean(blocks)), "blocks")
    say("cleanup", "blocks ordered and cleaned", progress=0.6)
    if pdf_blocks is not None:
        blocks = cut(align.align_positions(blocks, pdf_blocks), "blocks")
        if visuals is not None:
            blocks = cut(align.recover_visuals(blocks, visuals), "blocks")
        say("align", "blocks aligned with the second source", progress=0.8)
    blocks = cut(grouping.group_questions(grouping.merge_anchored(blocks)), "blocks")
    say("group", "boxes, examples and questions grouped", progress=0.9)
    sectioned = sections.section_blocks(blocks)
    secs = sections.sections(sectioned)
    docs = good.select("doc_id").distinct()
    titles = sections.guess_titles(blocks, docs.withColumn("stem", sections.stem_of(F.col("doc_id"))))
    html = render.render(sectioned, titles, config.profile)
    cover = coverage.coverage(paragraphs, blocks)
    stats = coverage.statistics(blocks, secs, assets, pages.groupBy("doc_id").agg(F.count("*").alias("source_pages")))
    report = qa.report([
        qa.profile_checks(docs, config.profile), qa.math_well_formed(docs, blocks), qa.images_linked(docs, blocks), qa.equations_resolved(docs, blocks),
        qa.no_empty_sections(docs, sectioned, secs, config.compat), qa.asset_checks(assets), qa.tables_covered(cover), qa.dynamic_checks(docs),
    ])
    return Conversion(good, pages, frames, paragraphs, blocks, secs, titles, html, assets, cover, stats, report)


def written_files(spark: SparkSession, out: str) -> DataFrame:
    """(document, rel): the files that the pages below ``out`` need and that lie there, with something in them."""
    files = packages.listing(spark, out).where("length > 0")
    pages = files.select(F.regexp_extract("dir", "/pages/document=([^/]*)$", 1).alias("document")).where("document <> ''").distinct()
    css = files.where(F.col("dir").endswith("/css")).limit(1).select(F.lit("css/styles.css").alias("rel"))
    return pages.withColumn("rel", F.lit("index.html")).unionByName(pages.join(F.broadcast(css)))  # one row


def write(result: Conversion, out: str, inputs: list[str] = (), progress: Progress | None = None, profile: MobileProfile | None = None) -> DataFrame:
    """Pages, style sheet, statistics and report below ``out``; returns the files that a page needs, checked where they lie.

    ``out/pages``, ``out/css``, ``out/stats``, ``out/qa``. Nothing is written into a folder of ``inputs``. The report holds
    the conversion's checks and that of the files.
    """
    say, began = (progress or Progress()).emit, time.time()
    spark = result.html.sparkSession
    sinks.write_pages(result.html, f"{out}/pages", [*inputs, *(f"{i}/pages" for i in inputs)])
    sinks.write_styles(spark, f"{out}/css", profile)
    sinks.write_json(result.stats, f"{out}/stats")
    folders = sinks.output_folders(result.html)
    files = cut(qa.required_files(folders, folders.join(written_files(spark, out), "document").select("doc_id", "rel")), "files")
    sinks.write_json(qa.report([result.qa, files]), f"{out}/qa")
    say("write", f"written in {time.time() - began:.1f} s", progress=1.0)
    return files


def inspect(parts: DataFrame) -> DataFrame:
    """One row a package: what is in it."""
    good = parts.where("part_name <> '!error'")
    pages, frames = idml.layout(good)
    return coverage.inspect(good, pages, frames)


def validate(spark: SparkSession, out: str) -> DataFrame:
    """Check converted folders again: the files that must be there, for each document that :func:`write` wrote below ``out``.

    Where there is none, every folder of ``out`` is taken for a document of its own.
    """
    files = written_files(spark, out).withColumnRenamed("document", "doc_id")
    if files.isEmpty():
        files = packages.listing(spark, out).withColumn("rel", F.expr(f"substring(path, length(regexp_extract(path, '^(.*?{re.escape(out.rstrip('/').rpartition('/')[2])})/', 1)) + 2)"))
        files = files.select(F.substring_index("rel", "/", 1).alias("doc_id"), F.regexp_replace("rel", "^[^/]*/", "").alias("rel"))
    docs = files.select("doc_id").distinct()
    return qa.report([qa.required_files(docs, files), qa.dynamic_checks(docs)])


def package_links(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, name, path): the linked files beside each package below ``path``, or beside the package ``path``."""
    files = packages.listing(spark, (path.rpartition("/")[0] or ".") if path.endswith(".idml") else path)
    links = files.where(file_name(F.col("dir")) == "Links").select(F.regexp_replace("dir", "/[^/]*$", "").alias("folder"), "name", "path")
    docs = files.where("ext = 'idml'").select(F.col("path").alias("doc_id"), F.col("dir").alias("folder"))
    return docs.join(links, "folder").select("doc_id", "name", "path")


def batch(spark: SparkSession, root: str, config: ConversionConfig | None = None) -> Conversion:
    """All packages below ``root`` in one job; packages that cannot be read are left out of it, see :func:`failures`."""
    return convert(packages.unpack(spark, root), config, package_links(spark, root))


def failures(parts: DataFrame) -> DataFrame:
    """(doc_id, error) of packages that could not be read."""
    return parts.where("part_name = '!error'").select("doc_id", F.decode("body", "UTF-8").alias("error"))


def return_codes(parts: DataFrame | None, report: DataFrame) -> DataFrame:
    """(doc_id, rc): 0 passed, 2 with errors, 1 not read (told from ``parts``, where they are given)."""
    ok = qa.verdicts(report).select("doc_id", F.when(F.col("passed"), 0).otherwise(2).alias("rc"))
    return ok if parts is None else ok.unionByName(failures(parts).select("doc_id", F.lit(1).alias("rc")))
