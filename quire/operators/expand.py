"""Stories to blocks: placements in order, with anchored boxes expanded where they stand.

A box is expanded at its first visit in depth-first order over the whole document, so what an earlier branch did decides
what a later one does. That is a fold, and runs per document, on Arrow batches of many; documents run in parallel. Paragraphs come
in typed and with their runs projected, so the fold only orders them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quire import schema

from .classify import CALLOUT_LABEL, EX_LABEL, LABEL_LENGTH, block_text, inline_runs, is_block, raw_text, type_of
from .folds import fold

MAX_DEPTH = 6
_LABEL = re.compile(f"{CALLOUT_LABEL}|{EX_LABEL}", re.I)


def box_tier(text: str, has_assets: bool) -> str:
    """``inline``, ``box`` or ``drop``: what becomes of an anchored frame's story."""
    if has_assets or len(text) <= LABEL_LENGTH and _LABEL.search(text):
        return "inline"
    tokens = text.split()
    if len(text) >= 40 and sum(len(t) >= 3 for t in tokens) >= 6:
        return "box"
    return "inline" if len(tokens) >= 3 and len(text) >= 12 else "drop"


class _Story:
    def __init__(self, paras: list[dict]):
        self.paras = paras
        self.text = " ".join(p["raw"] for p in self.paras).strip()
        self.has_assets = any(p["assets"] for p in self.paras)


class _Walk:
    """Depth-first expansion of one document."""

    def __init__(self, stories: dict[str, _Story]):
        self.stories, self.visited, self.boxes = stories, set(), 0

    def story(self, story_id: str, box: int = 0, depth: int = 0) -> Iterator[tuple[str, dict, int | None, int, bool]]:
        """(kind, paragraph, which of its tables, box, anchored) in order."""
        for p in self.stories[story_id].paras:
            if p["type"] is not None:
                yield "text", p, None, box, depth > 0
            for grid in range(p["grids"]):
                yield "table", p, grid, box, depth > 0
            if depth >= MAX_DEPTH:
                continue
            for child in p["boxes"]:
                if child in self.visited or child not in self.stories:
                    continue
                self.visited.add(child)
                inner = self.stories[child]
                tier = box_tier(inner.text, inner.has_assets)
                if tier == "drop":
                    continue
                if tier == "box":
                    self.boxes += 1
                yield from self.story(child, self.boxes if tier == "box" else box, depth + 1)


def prepared(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs ready for the walk: type and inline runs (null for blank ones), grids, box references."""
    runs = F.col("runs")
    p = paragraphs.withColumn("raw", raw_text(runs))
    solid = is_block(F.col("raw"), runs)
    p = p.withColumns({"type": F.when(solid, type_of(F.col("para_style"), F.col("raw"), runs)), "inline": F.when(solid, inline_runs(runs))})
    return p.select(
        "doc_id", "story_id", "para_ix", "raw",
        F.transform(F.filter("runs", lambda r: F.size(r["grid"]) > 0), lambda r: r["grid"]).alias("grids"),
        F.transform(F.filter("runs", lambda r: r["textframe_story"] != ""), lambda r: r["textframe_story"]).alias("boxes"),
        F.exists("runs", lambda r: (r["image_uri"] != "") | (F.size(r["grid"]) > 0) | (r["textframe_story"] != "")).alias("assets"),
        "type", "inline", block_text(F.col("inline")).alias("block_text"),
    )


def reconstruct(placements: DataFrame, paragraphs: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """``blocks`` of every document: stories expanded, images placed, all numbered in reading order.

    Placements of unknown stories are skipped. Without ``assets`` no image is placed; an image whose file was not found
    keeps its place with an empty source. Placements and paragraphs meet in one exchange.
    """
    if assets is not None:
        known = assets.select("doc_id", F.col("original_ref").alias("link_uri"), "output_rel", "original_name")
        placements = placements.join(known, ["doc_id", "link_uri"], "left")
    else:
        placements = placements.where("kind <> 'image'").withColumns({"output_rel": F.lit(None).cast("string"), "original_name": F.lit(None).cast("string")})

    def one(rows: list[tuple]) -> Iterator[tuple]:
        stories: dict[str, list[dict]] = {}
        placed = []
        for i, (_, side, _, story_id, kind, raw, grids, boxes, has_assets) in enumerate(rows):
            if side:
                placed.append((i, kind, story_id))
            else:
                stories.setdefault(story_id, []).append({"type": kind, "raw": raw, "grids": grids, "boxes": boxes, "assets": has_assets, "row": i})
        walk = _Walk({s: _Story(paras) for s, paras in stories.items()})
        order = 0
        for i, kind, story_id in placed:
            if kind == "image":
                yield order, "image", None, 0, False, i, None
                order += 1
            elif story_id in walk.stories:
                for what, p, grid, box, anchored in walk.story(story_id):
                    yield order, what, grid, box, anchored, i, p["row"]
                    order += 1

    place = F.struct("doc_id", "page_index", "col", "y", "x", "self_id", "output_rel", "link_uri", "original_name", "width", "height").alias("_place")
    para = F.struct("story_id", "type", "inline", "block_text", "grids").alias("_para")
    p = prepared(paragraphs).select("doc_id", F.lit(0).alias("_side"), F.col("para_ix").alias("_at"), "story_id", F.col("type").alias("_kind"), "raw", F.size("grids").alias("_grids"), "boxes", "assets", para)
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    g = placements.select("doc_id", F.lit(1).alias("_side"), F.col("placement_ix").alias("_at"), "story_id", F.col("kind").alias("_kind"), none(p, "raw"), F.lit(0).alias("_grids"), none(p, "boxes"), none(p, "assets"), none(p, "_para"), place)
    both = p.withColumn("_place", none(g, "_place")).unionByName(g)
    look = ["_side", "_at", "story_id", "_kind", "raw", "_grids", "boxes", "assets"]
    out = fold(both, ["_side", "_at"], one, "order_key int, block_kind string, grid_ix int, box_group int, anchored boolean", look, ["_place", "_para"])
    at, own, empty = F.col("_place"), F.col("_para"), F.lit("")
    image, text, table = (F.col("block_kind") == k for k in ("image", "text", "table"))
    made = {
        "doc_id": at["doc_id"], "type": F.when(text, own["type"]).otherwise(F.col("block_kind")), "page": at["page_index"], "col": at["col"], "x": F.when(image, at["x"]).otherwise(0.0), "y": at["y"], "story_id": F.when(text, own["story_id"]).otherwise(empty),
        "frame_id": F.when(image, at["self_id"]).otherwise(empty), "box_kind": empty, "ex_label": F.lit(False), "runs": F.when(text, own["inline"]), "text": F.when(text, own["block_text"]).otherwise(empty),
        "src": F.when(image, F.coalesce(at["output_rel"], empty)).otherwise(empty), "original_ref": F.when(image, at["link_uri"]).otherwise(empty), "alt": F.when(image, F.coalesce(at["original_name"], empty)).otherwise(empty),
        "width": F.when(image & (at["width"] != 0), at["width"]), "height": F.when(image & (at["height"] != 0), at["height"]), "latex": empty, "display": F.lit(None), "fallback_image": empty, "grid": F.when(table, F.get(own["grids"], F.col("grid_ix"))),
    }
    kinds = _parse_datatype_string(schema.BLOCKS)
    return out.select(*((made[f.name] if f.name in made else F.col(f.name)).cast(f.dataType).alias(f.name) for f in kinds.fields))
