"""Web pages as a source of blocks: text between tags, in order, JVM only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities that the text of pages is freed of: fixed values.
ENTITIES = (("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, "<[^>]*>", "")


def article(html: Column) -> Column:
    """What the page's article holds; of a page without one, all of it."""
    inner = F.substring_index(F.substring_index(html, "<article>", -1), "</article>", 1)
    return F.when(F.contains(html, F.lit("<article>")), inner).otherwise(html)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, para_ix, html): what follows each opening ``<p>`` of the article, closed or not."""
    parts = F.split(article(F.coalesce(F.col("html"), F.lit(""))), "<p>")
    return pages.select("page_id", F.posexplode(parts).alias("para_ix", "part")).where("para_ix > 0").select("page_id", (F.col("para_ix") - 1).alias("para_ix"), F.substring_index("part", "</p>", 1).alias("html"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link_ix, href) of every reference, in order."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), 1)).alias("link_ix", "href"))


def headings(tag: str) -> Column:
    return F.regexp_extract("html", f"<{tag}>(.*?)</{tag}>", 1)
