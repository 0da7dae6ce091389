"""Ordered blocks to HTML. What a renderer would remember from block to block is a window here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.config import MobileProfile
from quire.functions import html as H
from quire.functions.text import strip

from .classify import ci
from .cleanup import DOC, ORDER
from .grouping import QUESTION_SECTION
from .sequence import before, window

#: Labels of callouts, numbers of questions.
CALLOUT = r"key\s*note|advanced\s*learning|remember|do\s*you\s*know|mnemonic|caution|important\s*point|tips?\b"
QUESTION_NUMBER = r"^\s*(?:Q\.?\s*\d+|\d+)[.)]"
_HEADINGS = {"chapter_title": ("h1", "chapter-title"), "heading": ("h2", "heading"), "subheading": ("h3", "subhead")}
_CLASSES = ("question", "option", "solution", "example", "note")


def flags(sectioned: DataFrame, titles: DataFrame) -> DataFrame:
    """Blocks with what rendering asks of their neighbours: list and box edges, suppressed titles, repeated headings."""
    df = sectioned.join(titles.select("doc_id", F.lower(strip(F.col("title"))).alias("_title")), "doc_id", "left")
    t, text = strip(F.col("text")), F.col("block_kind") == "text"
    df = df.withColumns({"_t": t, "_norm": F.regexp_replace(F.lower(t), r"\s+", " "), "_box": F.coalesce("box_group", F.lit(0)), "_li": text & (F.col("type") == "list_item")})
    imageonly = text & (F.col("_t") == "") & F.exists(F.coalesce("runs", F.array()), lambda r: r["is_image"])
    heading = text & F.col("type").isin(*_HEADINGS)
    labelish = heading | (text & (F.col("type") == "paragraph") & (F.length("_t") <= 60))
    plain = text & ~imageonly & ~F.coalesce("ex_label", F.lit(False)) & ~F.col("type").isin("list_item", "subpoint", "caption")
    says = lambda p: F.col("text").rlike(ci(p))
    kind = (
        F.when(~text, F.col("block_kind")).when(imageonly, "image_only").when(F.col("ex_label"), "ribbon").when(F.col("type").isin("list_item", "subpoint", "caption"), F.col("type"))
        .when(F.col("type") == "chapter_title", "title").when(labelish & says(r"advanced\s*learning"), "hidden").when(labelish & says(CALLOUT), "callout").when(labelish & says(QUESTION_SECTION), "section_bar")
        .when(heading, "heading").otherwise("para")
    )
    df = df.withColumn("_kind", F.when(plain | ~text | imageonly | F.col("ex_label") | F.col("type").isin("list_item", "subpoint", "caption"), kind))
    # the first title or heading that says the document's title is left out
    same = F.col("_kind").isin("title", "heading") & (F.lower("_t") == F.col("_title"))
    df = df.withColumn("_same", F.coalesce(same, F.lit(False)))
    df = df.withColumn("_hidden", F.col("_same") & (F.coalesce(F.sum(F.col("_same").cast("int")).over(before(DOC, ORDER)), F.lit(0)) == 0))
    counts = (F.col("_kind") == "heading") & ~F.col("_hidden") & (F.col("_norm") != "")
    last = F.last(F.when((F.col("_kind") == "heading") & ~F.col("_hidden"), F.col("_norm")), ignorenulls=True).over(before(DOC, ORDER))
    df = df.withColumn("_repeat", F.coalesce(counts & (last == F.col("_norm")), F.lit(False)))
    w = window([*DOC, "section_ix"], ORDER)
    return df.withColumns({"_prev_box": F.coalesce(F.lag("_box").over(w), F.lit(0)), "_prev_li": F.coalesce(F.lag("_li").over(w), F.lit(False)), "_last": F.lead(F.lit(1)).over(w).isNull()})


def _edges() -> tuple[Column, Column]:
    """What opens before a block, and what closes after a section's last."""
    new_box = F.col("_box") != F.col("_prev_box")
    close_list = F.col("_prev_li") & (new_box | ~F.col("_li"))
    open_list = F.col("_li") & (new_box | ~F.col("_prev_li"))
    cls = F.when(F.col("box_kind") == "example", "box example").otherwise("box anchored")
    opening = F.concat(
        F.when(close_list, "</ul>\n").otherwise(""), F.when(new_box & (F.col("_prev_box") > 0), "</div>\n").otherwise(""),
        F.when(new_box & (F.col("_box") > 0), F.concat(F.lit('<div class="'), cls, F.lit('">\n'))).otherwise(""), F.when(open_list, '<ul class="bullets">\n').otherwise(""),
    )
    closing = F.when(F.col("_last"), F.concat(F.when(F.col("_li"), "</ul>\n").otherwise(""), F.when(F.col("_box") > 0, "</div>\n").otherwise(""))).otherwise("")
    return opening, closing


def block_html(key: Column) -> Column:
    """A block's own HTML, from its flags."""
    inner, kind = H.inline(F.col("runs")), F.col("_kind")
    wrap = lambda tag, cls, c=inner: F.concat(F.lit(f'<{tag} class="{cls}">'), c, F.lit(f"</{tag}>\n"))
    head = F.lit(None).cast("string")
    for t, (tag, cls) in _HEADINGS.items():
        head = F.when(F.col("type") == t, wrap(tag, cls)).otherwise(head)
    cls = F.when(F.col("type").isin(*_CLASSES), F.col("type")).otherwise("para")
    cls = F.when((cls == "question") & ~F.col("text").rlike(ci(QUESTION_NUMBER).replace("(?i)", "")), "qcont").otherwise(cls)
    ribbon = H.esc(F.regexp_replace(F.regexp_replace(F.col("_t"), r"\s+", " "), "(?i)^ex", "Ex"))
    note = F.when(F.col("text").rlike(r"(?i)key\s*note"), wrap("h3", "callout-head kn")).otherwise(wrap("h3", "callout-head"))
    return (
        F.when(F.col("_hidden") | (kind == "hidden"), "")
        .when(kind == "image_only", F.array_join(F.transform(F.filter("runs", lambda r: r["is_image"]), H.display_image), ""))
        .when(kind == "ribbon", wrap("div", "ex-ribbon", ribbon))
        .when(kind == "list_item", F.concat(F.lit("<li>"), H.bold_lead_in(inner), F.lit("</li>\n")))
        .when(kind.isin("subpoint", "caption"), H.paragraph(kind, inner, key))
        .when(kind == "callout", note)
        .when(kind == "section_bar", wrap("h3", "qsection-head"))
        .when(F.col("_repeat"), wrap("div", "sublabel"))
        .when(kind.isin("title", "heading"), head)
        .when(kind == "para", H.paragraph(cls, H.decorate(cls, inner), key))
        .when(kind == "image", H.image(F.coalesce("src", F.lit("")), F.coalesce("alt", F.lit(""))))
        .when(kind == "table", H.table(F.col("grid")))
        .when(kind == "math", H.math_block(F.coalesce("latex", F.lit("")), F.coalesce("display", F.lit(True)), F.coalesce("fallback_image", F.lit("")), key))
        .otherwise("")
    )


def rendered_blocks(sectioned: DataFrame, titles: DataFrame) -> DataFrame:
    """(doc_id, section_ix, order_key, html): each block with the edges around it."""
    opening, closing = _edges()
    key = F.concat_ws("|", "doc_id", F.col("order_key").cast("string"))
    return flags(sectioned, titles).select("doc_id", "section_ix", "order_key", F.concat(opening, F.coalesce(block_html(key), F.lit("")), closing).alias("html"))


def head(title: Column, profile: MobileProfile) -> Column:
    named = H.esc(F.when(title != "", title).otherwise("Mobile Document"))
    return F.concat(
        F.lit(f'<!doctype html>\n<html lang="en">\n<head>\n<meta charset="utf-8">\n<meta name="viewport" content="width={profile.page_width}, initial-scale=1, maximum-scale=1">\n<title>'), named,
        F.lit('</title>\n<link rel="stylesheet" href="css/katex.min.css">\n<link rel="stylesheet" href="css/styles.css">\n<script defer src="js/katex.min.js"></script>\n<script defer src="js/auto-render.min.js"></script>\n</head>\n<body>\n<main class="doc">\n'),
        F.when(title != "", F.concat(F.lit('<h1 class="doc-title">'), H.esc(title), F.lit("</h1>\n"))).otherwise(""),
    )


def render(sectioned: DataFrame, titles: DataFrame, profile: MobileProfile | None = None) -> DataFrame:
    """(doc_id, html): every document as one page. A document's page is one row, as it is one file."""
    ordered = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["html"]), "")
    per = rendered_blocks(sectioned, titles).groupBy("doc_id", "section_ix").agg(ordered(F.struct("order_key", "html")).alias("html"))
    per = per.withColumn("html", F.concat(F.lit('<section class="sec">\n'), F.col("html"), F.lit("</section>\n")))
    body = per.groupBy("doc_id").agg(ordered(F.struct("section_ix", "html")).alias("body"))
    out = titles.join(body, "doc_id", "left")
    return out.select("doc_id", F.concat(head(F.col("title"), profile or MobileProfile()), F.coalesce("body", F.lit("")), F.lit("</main>\n</body>\n</html>\n")).alias("html"))


def style_sheet(profile: MobileProfile | None = None, faces: list[tuple[str, str, str, str]] = (), extra: str = "") -> str:
    """The style sheet of a profile, with the given font faces (family, file, weight, style)."""
    p = profile or MobileProfile()
    rules = [f'@font-face{{font-family:"{n}";src:url("../{f}");font-weight:{w};font-style:{s}}}' for n, f, w, s in faces]
    if p.paginated:
        rules.append(f"@page{{size:{p.width_in:.4f}in {p.height_in:.4f}in;margin:0}}")
    rules += [
        f"html,body{{margin:0;width:{p.page_width}px;overflow-x:hidden}}",
        f'.doc{{box-sizing:border-box;width:{p.page_width}px;padding:{p.margin}px;font:{p.body_font_px:g}px/{p.line_height:g} "BodySerif",serif}}',
        f"img,table,.math-display{{max-width:{p.safe_content_width}px}}",
        'h1,h2,h3,.ex-ribbon{font-family:"HeadingSans",sans-serif;line-height:1.25}',
        "paragraph{display:block;margin:.5em 0}.qcont{margin-top:0}.subpoint{margin-left:1.2em}",
        f".caption{{font-size:{max(p.min_font_px, p.body_font_px - 2):g}px}}",
        ".box{border:1px solid currentColor;border-radius:6px;padding:8px;margin:12px 0}.box.example{border-style:dashed}",
        ".callout-head,.qsection-head,.ex-ribbon{font-weight:700;padding:4px 8px}.qsection-head{color:#fff;background:#223}",
        ".table-wrap,.math-display{overflow-x:auto}.tbl{border-collapse:collapse}.tbl th,.tbl td{border:1px solid;padding:4px}",
        "figure{margin:12px 0;text-align:center}.inline-eqn{vertical-align:middle}",
    ]
    return "\n".join([*rules, *([extra] if extra else [])]) + "\n"
