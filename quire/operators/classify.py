"""Paragraphs to typed blocks: by style name first, then by shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import strip

#: Patterns of style names and what they mean, the first that is found counts.
STYLE_RULES = (
    (r"chapter\s*name", "chapter_title"),
    (r"heading\s*2|heading\s*3|sub\s*hed|sub\s*head", "subheading"),
    (r"head-?13|\bhead\b|heading\s*1|head-", "heading"),
    (r"key\s*bullet|bullet", "list_item"),
    (r"indent|i to ii", "subpoint"),
    (r"figure|caption", "caption"),
    (r"example", "example"),
    (r"que\s*text|question|ques\b", "question"),
    (r"option|choice", "option"),
    (r"sol\s*text|solution|answer\s*key|answer|explanation", "solution"),
    (r"note|callout|tip|caution|important", "note"),
)
#: Shapes of options, questions and labels.
OPTION = r"^\s*\(?[A-Da-d1-4][\).]\s+"
QUESTION = r"^\s*(Q\.?\s*\d+|Question\s*\d+|\d+\.)\s"
CALLOUT_LABEL = r"key\s*note|remember|do\s*you\s*know"
EX_LABEL = r"^\s*ex[\s.\-]*\d+\b"
LABEL_LENGTH = 24


def ci(pattern: str) -> str:
    return "(?i)" + pattern


def style_type(style: Column) -> Column:
    """The type that a style name says, or null."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(STYLE_RULES):
        out = F.when(style.rlike(ci(pattern)), F.lit(kind)).otherwise(out)
    return out


def shape_type(text: Column, first_size: Column | None = None) -> Column:
    """The type that a text's shape says. A short text in large letters is a heading."""
    t = strip(text)
    out = F.when(t.rlike(OPTION) & (F.length(t) < 200), "option").when(t.rlike(ci(QUESTION)), "question")
    if first_size is not None:
        out = out.when((F.length(t) < 80) & (first_size >= 18), "heading")
    return out.otherwise("paragraph")


def block_type(style: Column, text: Column, first_size: Column | None = None) -> Column:
    return F.coalesce(style_type(style), shape_type(text, first_size))


def is_ex_label(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) <= LABEL_LENGTH) & t.rlike(ci(EX_LABEL))


def is_callout_label(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) <= LABEL_LENGTH) & (t.rlike(ci(CALLOUT_LABEL)) | t.rlike(ci(EX_LABEL)))


def raw_text(runs: Column) -> Column:
    """A paragraph's text: its runs', in order."""
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def inline_runs(runs: Column) -> Column:
    """Runs as blocks have them: graphics keep their reference, runs without text go, fonts are left behind."""
    kept = F.filter(runs, lambda r: (r["image_uri"] != "") | (r["text"] != ""))
    empty, no = F.lit(""), F.lit(False)

    def one(r: Column) -> Column:
        image = r["image_uri"] != ""
        flag = lambda n: F.when(image, no).otherwise(r[n]).alias(n)
        return F.struct(
            F.when(image, empty).otherwise(r["text"]).alias("text"), flag("bold"), flag("italic"), flag("superscript"), flag("subscript"),
            F.when(image, empty).otherwise(r["char_style"]).alias("char_style"), image.alias("is_image"), empty.alias("src"), r["image_uri"].alias("original_ref"),
            empty.alias("alt"), no.alias("tall"), F.lit(0.0).alias("max_h_px"), empty.alias("latex"),
        )

    return F.transform(kept, one)


def block_text(runs: Column) -> Column:
    """A block's text: that of its runs that are no graphics."""
    return F.array_join(F.transform(F.filter(runs, lambda r: ~r["is_image"]), lambda r: r["text"]), "")


def has_image(runs: Column) -> Column:
    return F.exists(runs, lambda r: r["is_image"])


def is_empty(df_runs: Column) -> Column:
    """No text and no graphic."""
    return (strip(block_text(df_runs)) == "") & ~has_image(df_runs)


def is_block(raw: Column, runs: Column) -> Column:
    """Whether a paragraph becomes a block: not if it is blank and without a graphic."""
    return (strip(raw) != "") | F.exists(runs, lambda r: r["image_uri"] != "")


def type_of(para_style: Column, raw: Column, runs: Column) -> Column:
    """A paragraph's block type, of its style, its text and the size of its first run."""
    return block_type(F.coalesce(para_style, F.lit("")), raw, runs[0]["point_size"])


def classify(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` to text blocks, with their place: blank ones without a graphic are left out."""
    out = paragraphs.withColumn("raw", raw_text(F.col("runs"))).where(is_block(F.col("raw"), F.col("runs")))
    kind = type_of(F.col("para_style"), F.col("raw"), F.col("runs"))
    return out.withColumn("type", kind).withColumn("runs", inline_runs(F.col("runs"))).withColumn("text", block_text(F.col("runs"))).drop("raw")
