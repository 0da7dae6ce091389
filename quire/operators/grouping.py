"""Boxes: anchored runs, worked examples, question groups."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .classify import EX_LABEL, LABEL_LENGTH, is_callout_label
from .cleanup import DOC, ORDER
from .folds import fold
from .sequence import islands, renumber, window

#: Headers of question sections, and of a chapter's own questions.
QUESTION_SECTION = r"check\s*your\s*understanding|\bquestions?\b|\bexercise\b|assignment|try\s*yourself|correct\s*type|numerical\s*type|comprehension|assertion|integer\s*type|match\s*the"
CHECK_HEADER = r"check\s*your\s*understanding"
_HEADINGS = ("chapter_title", "heading", "subheading")
_ASKED = ("question", "option")


def merge_anchored(blocks: DataFrame) -> DataFrame:
    """Each maximal run of anchored blocks is one callout box, labels first; all in windows over one order."""
    w = window(DOC, ORDER)
    top = F.coalesce(F.max("box_group").over(W.partitionBy(*DOC)), F.lit(0))
    df = blocks.withColumn("_top", top)
    df = islands(df, DOC, ORDER, F.col("anchored") & ~F.coalesce(F.lag("anchored").over(w), F.lit(False)), "_run")
    label = F.coalesce((F.col("block_kind") == "text") & is_callout_label(F.col("text")), F.lit(False))
    df = df.withColumn("_head", F.col("anchored") & label)
    # a run keeps its place: rows sort by the place where their run begins, labels first
    df = df.withColumn("_at", F.when(F.col("anchored"), F.min("order_key").over(W.partitionBy(*DOC, "anchored", "_run"))).otherwise(F.col("order_key")))
    df = df.withColumns({"box_group": F.when(F.col("anchored"), F.col("_top") + F.col("_run")).otherwise(F.col("box_group")).cast("int"), "box_kind": F.when(F.col("anchored"), "callout").otherwise(F.col("box_kind"))})
    df = df.withColumn("_later", (~F.col("_head")).cast("int")).withColumnRenamed("order_key", "_old")
    return renumber(df, DOC, ["_at", "_later", "_old"], "order_key").select(*blocks.columns)


_SEEN = ["order_key", "block_kind", "type", "text", "box_group", "box_kind", "anchored", "ex_label"]
_WALKED = ("order_key", "box_group", "box_kind", "anchored", "ex_label")


def _fold(blocks: DataFrame, walk) -> DataFrame:
    """Apply a walk over the ordered rows of each document, on the few columns that it needs.

    The walk sees dicts and returns them in their new order; other columns follow as they are.
    """

    def one(rows: list[tuple]) -> Iterator[tuple]:
        for i, r in enumerate(walk([dict(zip(_SEEN, r[1:]), _row=at) for at, r in enumerate(rows)])):
            yield i, r["box_group"], r["box_kind"], r["anchored"], r["ex_label"], r["_row"]

    rest = F.struct(*(c for c in blocks.columns if c not in _WALKED)).alias("_rest")
    out = fold(blocks.select("doc_id", *_SEEN, rest), ["order_key"], one, "order_key int, box_group int, box_kind string, anchored boolean, ex_label boolean", _SEEN, ["_rest"])
    return out.select(*(F.col(c) if c in _WALKED else F.col(f"_rest.{c}") for c in blocks.columns))


def _says(pattern: str):
    found = re.compile(pattern, re.I)
    return lambda r: r["block_kind"] == "text" and found.search(r["text"] or "") is not None


_ribbon_text, _section_bar, _check = _says(EX_LABEL), _says(QUESTION_SECTION), _says(CHECK_HEADER)
_worked = _says(r"^\s*sol\b")


def _ribbon(r: dict) -> bool:
    return _ribbon_text(r | {"text": (r["text"] or "").strip()}) and len((r["text"] or "").strip()) <= LABEL_LENGTH


def _asks(r: dict) -> bool:
    answers = r["type"] == "solution" or _worked(r)
    return r["block_kind"] == "text" and not answers and r["type"] in ("question", "paragraph")


def _stops(r: dict) -> bool:
    return _ribbon(r) or r["block_kind"] == "text" and (r["type"] in _HEADINGS or _section_bar(r)) or r["box_kind"] == "callout"


def example_walk(rows: list[dict]) -> list[dict]:
    """Each ribbon's box takes the question before it and what follows, up to a boundary or the next example's question."""
    ribbons = [i for i, r in enumerate(rows) if _ribbon(r)]
    if not ribbons:
        return rows
    top = max(r["box_group"] or 0 for r in rows)
    for box, (at, next_) in enumerate(zip(ribbons, [*ribbons[1:], len(rows)]), top + 1):
        mine = [at]
        rows[at] |= {"ex_label": True, "anchored": False}
        if at and _asks(rows[at - 1]) and rows[at - 1]["box_kind"] not in ("callout", "example"):
            mine.append(at - 1)
        stop = next_ - 1 if next_ < len(rows) and _asks(rows[next_ - 1]) else next_
        for k in range(at + 1, stop):
            if _stops(rows[k]):
                break
            mine.append(k)
        for k in mine:
            rows[k] |= {"box_group": box, "box_kind": "example"}
    out: list[dict] = []
    at = 0
    while at < len(rows):
        first, end = rows[at], at + 1
        if first["box_group"] and first["box_kind"] == "example":
            while end < len(rows) and rows[end]["box_group"] == first["box_group"]:
                end += 1
        out += sorted(rows[at:end], key=lambda r: not r["ex_label"]) if first["box_kind"] == "example" else rows[at:end]
        at = end
    return out


def question_walk(rows: list[dict]) -> list[dict]:
    """A header found after its questions moves before them; header and questions share a box."""
    at = 0
    asked = lambda r: r["block_kind"] == "text" and r["type"] in _ASKED
    while at < len(rows):
        if not _check(rows[at]):
            at += 1
            continue
        start = at
        while start and asked(rows[start - 1]) and rows[start - 1]["box_kind"] != "example":
            start -= 1
        rows.insert(start, rows.pop(at))
        end = start + 1
        while end < len(rows) and asked(rows[end]):
            end += 1
        box = max(r["box_group"] or 0 for r in rows) + 1
        for r in rows[start:end]:
            r |= {"box_group": box, "box_kind": "questions"}
        at = end
    return rows


def group_examples(blocks: DataFrame) -> DataFrame:
    """Worked examples in boxes, ribbon first. Each box depends on those before it: a fold per document."""
    return _fold(blocks, example_walk)


def hoist_question_headers(blocks: DataFrame) -> DataFrame:
    """Question headers above their questions. A fold per document, as moved rows are seen by the next header."""
    return _fold(blocks, question_walk)


def group_questions(blocks: DataFrame) -> DataFrame:
    """:func:`group_examples`, then :func:`hoist_question_headers`, in one fold."""
    return _fold(blocks, lambda rows: question_walk(example_walk(rows)))
