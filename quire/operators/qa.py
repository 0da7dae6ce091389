"""Checks of converted documents: a long table (doc_id, check, ok, is_error, skipped, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import MobileProfile
from quire.functions.latex import balanced
from quire.functions.text import strip

COLUMNS = ["doc_id", "check", "ok", "is_error", "skipped", "detail"]
#: Checks that need a browser; there is none, and they say so instead of passing.
DYNAMIC = (("horizontal_overflow", True), ("no_clipped_images", False), ("no_broken_images", True), ("katex_rendered_ok", True))


def _rule(df: DataFrame, name: str, ok: Column, detail: Column, error: bool = False) -> DataFrame:
    return df.select("doc_id", F.lit(name).alias("check"), ok.alias("ok"), F.lit(error).alias("is_error"), F.lit(False).alias("skipped"), detail.cast("string").alias("detail"))


def _listing(docs: DataFrame, bad: DataFrame, name: str, key: str, error: bool = False) -> DataFrame:
    """ok where a document has no ``bad(doc_id, ix, what)``; they are listed in order."""
    found = bad.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ix", "what"))), lambda x: x["what"]).alias("l"))
    j = docs.select("doc_id").join(found, "doc_id", "left")
    return _rule(j, name, F.col("l").isNull(), F.to_json(F.struct(F.coalesce("l", F.array().cast("array<string>")).alias(key))), error)


def required_files(docs: DataFrame, files: DataFrame) -> DataFrame:
    """index.html and css/styles.css are among ``files(doc_id, rel)``."""
    want = docs.select("doc_id", F.posexplode(F.array(F.lit("index.html"), F.lit("css/styles.css"))).alias("ix", "what"))
    return _listing(docs, want.join(files.withColumnRenamed("rel", "what"), ["doc_id", "what"], "left_anti"), "required_files", "missing", True)


def profile_checks(docs: DataFrame, profile: MobileProfile) -> DataFrame:
    font_ok = profile.body_font_px >= profile.min_font_px >= 13
    font = _rule(docs, "min_font_size", F.lit(font_ok), F.to_json(F.struct(F.lit(profile.body_font_px).alias("body"), F.lit(profile.min_font_px).alias("min"))), True)
    width_ok = profile.page_width == 360 and profile.safe_content_width == 328
    return font.unionByName(_rule(docs, "page_width_contract", F.lit(width_ok), F.to_json(F.struct(F.lit(profile.page_width).alias("page_width"), F.lit(profile.safe_content_width).alias("safe_width")))))


def math_well_formed(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    latex = F.coalesce("latex", F.lit(""))
    bad = blocks.where((F.col("block_kind") == "math") & (F.coalesce("fallback_image", F.lit("")) == "") & (~balanced(latex) | (strip(latex) == "")))
    return _listing(docs, bad.select("doc_id", F.col("order_key").alias("ix"), F.substring(latex, 1, 60).alias("what")), "math_well_formed", "broken")


def images_linked(docs: DataFrame, blocks: DataFrame, files: DataFrame | None = None) -> DataFrame:
    images = blocks.where("block_kind = 'image'").select("doc_id", F.col("order_key").alias("ix"), "src", "original_ref")
    if files is not None:
        images = images.join(files.select("doc_id", F.col("rel").alias("src"), F.lit(True).alias("there")).distinct(), ["doc_id", "src"], "left")
    else:
        images = images.withColumn("there", F.lit(True))
    what = F.when(F.col("src") == "", F.when(F.col("original_ref") == "", "(no ref)").otherwise(F.col("original_ref"))).when(F.col("there").isNull(), F.col("src"))
    return _listing(docs, images.select("doc_id", "ix", what.alias("what")).where("what is not null"), "images_linked", "missing")


def equations_resolved(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    open_ = F.size(F.filter(F.coalesce("runs", F.array()), lambda r: r["is_image"] & r["original_ref"].rlike(r"(?i)\.(wmf|emf)$") & (r["src"] == "") & (r["latex"] == "")))
    n = blocks.where("block_kind = 'text'").groupBy("doc_id").agg(F.sum(open_).alias("n"))
    j = docs.select("doc_id").join(n, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return _rule(j, "inline_equations_resolved", F.col("n") == 0, F.to_json(F.struct(F.col("n").alias("unresolved"))))


def no_empty_sections(docs: DataFrame, sectioned: DataFrame, sections: DataFrame, compat: bool = False) -> DataFrame:
    """A section without content is empty; with ``compat`` tables alone are no content."""
    solid = (F.col("block_kind") == "text") & ((strip(F.col("text")) != "") | F.exists(F.coalesce("runs", F.array()), lambda r: r["is_image"])) | F.col("block_kind").isin("image", "math", *(() if compat else ("table",)))
    full = sectioned.groupBy("doc_id", "section_ix").agg(F.bool_or(solid).alias("solid"))
    bad = sections.join(full, ["doc_id", "section_ix"], "left").where(~F.coalesce("solid", F.lit(False)))
    return _listing(docs, bad.select("doc_id", F.col("section_ix").alias("ix"), F.when(F.col("title") == "", "(untitled)").otherwise(F.col("title")).alias("what")), "no_empty_sections", "empty")


def asset_checks(assets: DataFrame) -> DataFrame:
    """For documents that have assets: all found, and all that were found converted or copied."""
    docs = assets.select("doc_id").distinct()
    row = lambda cond: assets.where(cond).select("doc_id", F.col("first_ix").alias("ix"), F.col("original_name").alias("what"))
    return _listing(docs, row("not found"), "assets_found", "missing").unionByName(_listing(docs, row("found and output_rel = ''"), "assets_converted", "unconverted"))


def tables_covered(coverage: DataFrame) -> DataFrame:
    return _rule(coverage, "tables_covered", F.col("tables") >= F.col("src_tables"), F.to_json(F.struct(F.col("src_tables").alias("source"), F.col("tables").alias("rendered"))))


def dynamic_checks(docs: DataFrame) -> DataFrame:
    """The browser's checks, as skipped."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.lit(e).alias("is_error")) for n, e in DYNAMIC])).alias("r")
    return docs.select("doc_id", rows).select("doc_id", "r.check", F.lit(True).alias("ok"), "r.is_error", F.lit(True).alias("skipped"), F.lit(None).cast("string").alias("detail"))


def report(rules: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select(*COLUMNS) for r in rules])


def verdicts(qa: DataFrame) -> DataFrame:
    """(doc_id, passed, warnings, errors): an error fails a document, a warning does not."""
    names = lambda cond: F.sort_array(F.collect_list(F.when(~F.col("ok") & cond, F.col("check"))))
    return qa.groupBy("doc_id").agg(F.bool_and(F.col("ok") | ~F.col("is_error")).alias("passed"), names(~F.col("is_error")).alias("warnings"), names(F.col("is_error")).alias("errors"))
