"""HTML of runs and blocks, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .latex import plain_text


def esc(c: Column, quote: bool = True) -> Column:
    """Text safe in HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quote else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def tagged(tag: str, inner: Column, attrs: str = "") -> Column:
    return F.concat(F.lit(f"<{tag}{attrs}>"), inner, F.lit(f"</{tag}>"))


def _or_self(test: Column, new: Column, old: Column) -> Column:
    return F.when(test, new).otherwise(old)


def _math(latex: Column, shape: str) -> Column:
    """``shape``: ``inline``, ``inline-block`` or ``display``."""
    tag = "div" if shape == "display" else "span"
    a, b = ("\\(", "\\)") if shape == "inline" else ("\\[", "\\]")
    return F.concat(F.lit(f'<{tag} class="math-{shape}" data-latex="'), esc(latex), F.lit(f'">{a}'), latex, F.lit(f"{b}</{tag}>"))


def _height(px: Column) -> Column:
    return F.when(px > 0, F.concat(F.lit(' style="max-height:'), F.bround(px).cast("long").cast("string"), F.lit('px"'))).otherwise("")


def _img(r: Column, cls: str) -> Column:
    alt = F.when(r["alt"] != "", r["alt"]).otherwise("equation")
    return F.concat(F.lit(f'<img class="{cls}" src="'), esc(r["src"]), F.lit('" alt="'), esc(alt), F.lit('"'), _height(r["max_h_px"]), F.lit(">"))


def inline_image(r: Column) -> Column:
    """A graphic inside a text: mathematics, else an image, else nothing."""
    return (
        F.when(r["latex"] != "", F.when(r["tall"], _math(r["latex"], "inline-block")).otherwise(_math(r["latex"], "inline")))
        .when(r["src"] != "", _img(r, "inline-eqn"))
        .otherwise("")
    )


def display_image(r: Column) -> Column:
    """A graphic that is a paragraph's only content."""
    figure = F.concat(F.lit('<figure class="math-display">'), _img(r, "block-eqn"), F.lit("</figure>\n"))
    return F.when(r["latex"] != "", F.concat(_math(r["latex"], "display"), F.lit("\n"))).when(r["src"] != "", figure).otherwise("")


def inline(runs: Column) -> Column:
    """Runs in order, with their styling nested."""

    def one(r: Column) -> Column:
        t = F.replace(esc(r["text"]), F.lit("\n"), F.lit("<br>"))
        t = F.when(r["superscript"], tagged("sup", t)).when(r["subscript"], tagged("sub", t)).otherwise(t)
        t = _or_self(r["bold"], tagged("strong", t), t)
        t = _or_self(r["italic"], tagged("em", t), t)
        return F.when(r["is_image"], inline_image(r)).otherwise(t)

    return F.array_join(F.transform(runs, one), "")


def bold_lead_in(inner: Column) -> Column:
    """A short label before a colon in bold."""
    at = F.locate(":", inner)
    head = F.substring_index(inner, ":", 1)
    fits = (at > 1) & (F.length(head) <= 42) & ~F.contains(head, F.lit("<br>")) & ~F.contains(head, F.lit("\\(")) & ~inner.startswith("<strong>")
    return F.when(fits, F.concat(F.lit("<strong>"), head, F.lit(":</strong>"), inner.substr(at + 1, F.length(inner)))).otherwise(inner)


def decorate(cls: Column, inner: Column) -> Column:
    """Question numbers, and speakers at the start of a line, in spans of their own."""
    number = F.regexp_replace(inner, r"^(\s*(?:Q\.?\s*\d+|\d+)[.)]?)", '<span class="qnum">$1</span>')
    speaker = F.regexp_replace(inner, r"(^|<br>)(\s*[A-Z][A-Za-z]{1,18}:)", '$1<span class="speaker">$2</span>')
    return F.when(cls == "question", number).when(cls == "para", speaker).otherwise(inner)


def paragraph(cls: Column, inner: Column, key: Column) -> Column:
    """A paragraph whose id is made of its place, so that a second run gives the same."""
    return F.concat(F.lit('<paragraph id="'), F.substring(F.sha2(key, 256), 1, 32), F.lit('" class="'), cls, F.lit('">'), inner, F.lit("</paragraph>\n"))


def table(grid: Column) -> Column:
    """A grid as a table, its first row headers."""

    def cell(c: Column, tag: Column) -> Column:
        span = lambda n: F.when(c[n] > 1, F.concat(F.lit(f' {n}="'), c[n].cast("string"), F.lit('"'))).otherwise("")
        content = F.when(F.coalesce(c["html"], F.lit("")) != "", c["html"]).otherwise(esc(F.coalesce(c["text"], F.lit(""))))
        return F.concat(F.lit("<"), tag, span("colspan"), span("rowspan"), F.lit(">"), content, F.lit("</"), tag, F.lit(">"))

    def row(r: Column, i: Column) -> Column:
        tag = F.when(i == 0, "th").otherwise("td")
        return tagged("tr", F.array_join(F.transform(r, lambda c: cell(c, tag)), ""))

    return F.concat(F.lit('<div class="table-wrap"><table class="tbl">'), F.array_join(F.transform(grid, row), ""), F.lit("</table></div>\n"))


def image(src: Column, alt: Column) -> Column:
    cls = F.when(alt == "chapter opener", "opener").when(alt == "chapter finisher", "finisher").otherwise("fig")
    return F.when(src == "", "").otherwise(F.concat(F.lit('<figure class="'), cls, F.lit('"><img src="'), esc(src), F.lit('" alt="'), esc(F.coalesce(alt, F.lit(""))), F.lit('" loading="lazy" decoding="async"></figure>\n')))


def math_block(latex: Column, display: Column, fallback: Column, key: Column) -> Column:
    shown = F.concat(F.lit('<div class="math-display" data-latex="'), esc(latex), F.lit('">'), F.when(display, F.lit("\\[")).otherwise(F.lit("\\(")), latex, F.when(display, F.lit("\\]")).otherwise(F.lit("\\)")), F.lit("</div>\n"))
    picture = F.concat(F.lit('<figure class="math-display"><img src="'), esc(fallback), F.lit('" alt="equation"></figure>\n'))
    return F.when(F.trim(latex) != "", shown).when(fallback != "", picture).otherwise(paragraph(F.lit("para"), esc(plain_text(latex)), key))
