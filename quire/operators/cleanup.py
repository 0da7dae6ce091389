"""Cleaning of ordered blocks: a chain of transforms ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import ends_sentence, strip

from .classify import block_text, has_image
from .sequence import before, collapse_repeats, islands, renumber, window

DOC = ["doc_id"]
ORDER = ["order_key"]
Pass = Callable[[DataFrame], DataFrame]


def clean_spaces(c: Column) -> Column:
    """Line and paragraph separators are spaces; runs of spaces and tabs are one."""
    c = F.translate(c, "\u2028\u2029", "  ")
    # a single space is what it is to be: only texts with more than that are searched
    return F.when(F.contains(c, F.lit("  ")) | F.contains(c, F.lit("\t")), F.regexp_replace(c, " [ \t]+|\t[ \t]*", " ")).otherwise(c)


def normalize_whitespace(blocks: DataFrame) -> DataFrame:
    """Clean the spaces of every run, then cut blank runs from both ends of a block."""
    text = F.col("block_kind") == "text"
    # column by column, so that none is computed again for each use
    out = blocks.withColumn("_runs", F.when(text, F.transform("runs", lambda r: r.withField("text", clean_spaces(r["text"])))))
    out = out.withColumn("_solid", F.transform("_runs", lambda r: r["is_image"] | (strip(r["text"]) != "")))
    out = out.withColumn("_first", F.array_position("_solid", True).cast("int"))
    last = (F.size("_solid") - F.array_position(F.reverse("_solid"), True) + 1).cast("int")
    kept = F.when(F.col("_first") > 0, F.slice("_runs", F.col("_first"), last - F.col("_first") + 1)).otherwise(F.slice("_runs", 1, 0))
    out = out.withColumn("runs", F.when(text, kept).otherwise(F.col("runs")))
    return out.withColumn("text", F.when(text, block_text(F.col("runs"))).otherwise(F.col("text"))).select(*blocks.columns)


def group_broken(df: DataFrame, by: list[str], order: list, text: Column, joinable: Column, same: list[str], name: str) -> DataFrame:
    """``name``: number of the merged row that each row goes to.

    A joinable row goes on from the joinable one before it, of the same ``same``, unless the text so far is blank or ends
    a sentence. The text so far ends as the last text that was not blank, so no fold is needed.
    """
    w = window(by, order)
    df = df.withColumns({"_t": text, "_j": F.coalesce(joinable, F.lit(False))})
    fresh = ~F.col("_j") | ~F.coalesce(F.lag("_j").over(w), F.lit(False))
    for c in same:
        fresh = fresh | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    df = islands(df.withColumn("_fresh", fresh), by, order, F.col("_fresh"), "_run")
    tail = F.last(F.when(strip(F.col("_t")) != "", F.col("_t")), ignorenulls=True).over(before([*by, "_run"], order))
    df = df.withColumn("_tail", tail)
    start = F.col("_fresh") | F.col("_tail").isNull() | ends_sentence(F.col("_tail"))
    return islands(df.withColumn("_s", start), by, order, F.col("_s"), name).drop("_t", "_j", "_fresh", "_run", "_tail", "_s")


def needs_space(prev_last_text: Column) -> Column:
    """Whether a joined text needs a space after the one before."""
    return (F.coalesce(prev_last_text, F.lit("")) != "") & ~prev_last_text.endswith(" ")


def merge_broken(blocks: DataFrame) -> DataFrame:
    """Join a paragraph to the one before it of the same story that ends in mid-sentence."""
    paragraph = (F.col("block_kind") == "text") & (F.col("type") == "paragraph")
    out = group_broken(blocks, DOC, ORDER, F.col("text"), paragraph, ["story_id"], "_group")
    last = F.when(F.size("runs") > 0, F.element_at("runs", -1)["text"]).otherwise("")
    w = window(DOC, ORDER)
    out = out.withColumn("_lead", F.lag(last).over(w)).withColumn("_goes_on", F.lag("_group").over(w) == F.col("_group"))
    plain = blocks.schema["runs"].dataType.elementType
    space = F.array(F.from_json(F.lit('{"text":" ","bold":false,"italic":false,"superscript":false,"subscript":false,"char_style":"","is_image":false,"src":"","original_ref":"","alt":"","tall":false,"max_h_px":0.0,"latex":""}'), plain))
    runs = F.when(F.coalesce(F.col("_goes_on"), F.lit(False)) & needs_space(F.col("_lead")), F.concat(space, F.col("runs"))).otherwise(F.col("runs"))
    out = out.withColumn("runs", runs)
    # one list of rows for a group: its first row gives all but the runs
    ordered = F.sort_array(F.collect_list(F.struct("order_key", *(c for c in blocks.columns if c not in ("doc_id", "order_key")))))
    merged = out.groupBy("doc_id", "_group").agg(ordered.alias("_rows")).withColumn("_one", F.col("_rows")[0])
    text = F.col("_one.block_kind") == "text"
    joined = F.when(text, F.flatten(F.transform("_rows", lambda x: x["runs"])))
    merged = merged.withColumn("runs", joined).withColumn("text", F.when(text, block_text(F.col("runs"))).otherwise(F.col("_one.text")))
    merged = merged.select("doc_id", "runs", "text", *(F.col(f"_one.{c}").alias(c) for c in blocks.columns if c not in ("doc_id", "runs", "text")))
    return merged.select(*blocks.columns)


def drop_empty(blocks: DataFrame) -> DataFrame:
    """Text blocks without text and graphics go."""
    blank = (F.col("block_kind") == "text") & (strip(F.col("text")) == "") & ~has_image(F.col("runs"))
    return blocks.where(~F.coalesce(blank, F.lit(False)))


def collapse_headings(blocks: DataFrame) -> DataFrame:
    """A heading or chapter title that repeats the block before it goes."""
    heading = (F.col("block_kind") == "text") & F.col("type").isin("heading", "chapter_title")
    value = F.struct("block_kind", "type", strip(F.col("text")).alias("t"))
    return collapse_repeats(blocks, DOC, ORDER, F.when(heading, value))


DEFAULT_CHAIN: tuple[Pass, ...] = (normalize_whitespace, merge_broken, drop_empty, collapse_headings)


def clean(blocks: DataFrame, chain: Iterable[Pass] = DEFAULT_CHAIN) -> DataFrame:
    """Run the chain, then number the blocks anew."""
    for p in chain:
        blocks = blocks.transform(p)
    return renumber(blocks.withColumnRenamed("order_key", "_old"), DOC, ["_old"], "order_key").select(*blocks.columns)


def drop_layout_panels(blocks: DataFrame, reach: int = 11) -> DataFrame:
    """Drop print navigation: from ``years paper`` up to ``solutions``, or through ``n sets``, within ``reach`` blocks.

    Panels that overlap end at the same block, so the union of all ranges is what a left-to-right walk deletes.
    """
    t = F.when(F.col("block_kind") == "text", F.lower(strip(F.col("text")))).otherwise("")
    df = renumber(blocks.withColumn("_t", t), DOC, ORDER, "_ix")
    stop = F.when(F.col("_t") == "solutions", F.col("_ix")).when(F.col("_t").rlike(r"^\d+\s*sets?$"), F.col("_ix") + 1)
    df = df.withColumn("_stop", stop)
    ahead = window(DOC, ["_ix"]).rowsBetween(1, reach)
    df = df.withColumn("_to", F.when(F.col("_t") == "years paper", F.first("_stop", ignorenulls=True).over(ahead)))
    from .sequence import delete_ranges

    return delete_ranges(df, DOC, "_ix", F.col("_to")).select(*blocks.columns)


