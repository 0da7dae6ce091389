"""Text functions over Columns. They run in the JVM and fold into whole-stage code."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space that ends of texts lose: all of Unicode's, and the four information separators.
_WS = r"(?U)[\s\x1C-\x1F]+"
#: The same, one by one: ends are looked at without a scan of the text.
_SPACES = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """``c`` without white space at its ends, no-break spaces included."""
    return F.trim(c, F.lit(_SPACES))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(_SPACES))


def words(c: Column) -> Column:
    """Words of a text: runs of anything but white space."""
    s = strip(c)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, _WS))


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces made one; ends stripped."""
    return strip(F.regexp_replace(c, " {2,}", " "))


def match_norm(c: Column) -> Column:
    """The form in which texts of two sources are compared: lower case, runs of all but a-z, 0-9 and % one space."""
    lower = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("\u00ad"), F.lit(""))
    return F.trim(F.regexp_replace(lower, "[^a-z0-9%]+", " "))


def unquote(c: Column) -> Column:
    """Percent-decoding that keeps plus signs; a malformed escape leaves the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def file_name(c: Column) -> Column:
    """The last part of a path."""
    return F.substring_index(F.regexp_replace(c, "/+$", ""), "/", -1)


def link_key(c: Column) -> Column:
    """A link's basename as lookups know it: decoded, either slash, trimmed, lower case."""
    return F.lower(strip(file_name(F.replace(unquote(F.coalesce(c, F.lit(""))), F.lit("\\"), F.lit("/")))))


def short_style(c: Column) -> Column:
    """The last part of an applied style's path."""
    return strip(F.replace(F.substring_index(F.coalesce(c, F.lit("")), "/", -1), F.lit("$ID/"), F.lit("")))


def safe_stem(c: Column) -> Column:
    """A file name without its extension, of safe characters only; ``asset`` where nothing is left."""
    name = file_name(c)
    stem = F.when(F.locate(".", name, 2) > 0, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    safe = F.regexp_replace(F.regexp_replace(stem, "[^A-Za-z0-9_.-]+", "_"), "^_+|_+$", "")
    return F.when(safe == "", F.lit("asset")).otherwise(safe)


def tidy_story_text(c: Column, compat: bool = False) -> Column:
    """Story text: separators become line breaks, tabs and runs of spaces one space.

    ``compat`` also takes three question marks for a line break, as older tools did.
    """
    out = F.regexp_replace(c, "[\u2028\u2029]", "\n")
    if compat:
        out = F.replace(out, F.lit("???"), F.lit("\n"))
    return F.regexp_replace(F.replace(out, F.lit("\t"), F.lit(" ")), " {2,}", " ")


@F.pandas_udf(StringType())
def repair_encoding(s: pd.Series) -> pd.Series:
    """UTF-8 that was read as Windows-1252, read aright; other texts stay."""
    marks = ("\u00c2", "\u00c3", "\u00e2")  # what such damage begins with

    def fix(t):
        if t is None or not any(m in t for m in marks):
            return t
        try:
            return t.encode("cp1252").decode("utf-8")
        except UnicodeError:
            return t

    return s.map(fix, na_action="ignore")


def symbol_text(text: Column, font: Column) -> Column:
    """Private-use glyphs of two symbol fonts as plain characters."""
    f = F.lower(F.coalesce(font, F.lit("")))
    return (
        F.when(f.isin("mt extra", "mt extra tiger"), F.translate(text, "\uf06c\uf083\uf051", "l\u21ccC"))
        .when(f == "symbol", F.replace(text, F.lit("\uf8e7"), F.lit("")))
        .otherwise(text)
    )


@F.pandas_udf(StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Capitals after every character that is no letter, which ``initcap`` does not do."""
    return s.str.title()


def duration(seconds: Column) -> Column:
    """``12.3s`` under a minute, then ``2m 05s``."""
    whole = F.bround(seconds).cast("long")
    return F.when(seconds < 60, F.format_string("%.1fs", F.bround(seconds.cast("double"), 1))).otherwise(F.format_string("%dm %02ds", (whole / 60).cast("long"), whole % 60))


def round_half_even(c: Column, scale: int = 0) -> Column:
    return F.bround(c, scale)


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole to one place; 100 of nothing."""
    return F.when(whole == 0, F.lit(100.0)).otherwise(F.bround(100.0 * part / whole, 1))


#: Characters that end a sentence: fixed values.
SENTENCE_ENDS = (".", "!", "?", ":", ";", "\u201d", '"', ")")


def ends_sentence(c: Column) -> Column:
    return F.substring(rstrip(c), -1, 1).isin(*SENTENCE_ENDS)


def words_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def token_estimate(chars: Column) -> Column:
    """A token for every four characters, rounded up."""
    return F.ceil(chars / 4).cast("long")
