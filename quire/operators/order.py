"""Reading order: frames to placements, by strategies chosen by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import schema

from .sequence import first_per_key, renumber

_PLACE = ["page_index", "col", "y", "x", "frame_ix"]
_COLS = [c.split()[0] for c in schema.PLACEMENTS.split(", ")]


def _placements(frames: DataFrame, rank: list) -> DataFrame:
    """The first text frame of each story by ``rank``, and every image frame."""
    texts = first_per_key(frames.where("kind = 'text' and story_id <> ''"), ["doc_id", "story_id"], rank).withColumn("kind", F.lit("story"))
    images = frames.where("kind = 'image'").withColumn("story_id", F.lit(""))
    return texts.unionByName(images)


def _by_place(placed: DataFrame, tie: list[Column]) -> DataFrame:
    """Number by page, column and rounded position; equal positions keep the order in which they were found."""
    out = renumber(placed, ["doc_id"], ["page_index", "col", F.bround("y", 1), F.bround("x", 1), *tie], "placement_ix")
    return out.select(*_COLS)


def geometric(frames: DataFrame) -> DataFrame:
    """Page, left column before right, top to bottom, left to right."""
    story_first = [F.when(F.col("kind") == "story", 0).otherwise(1), *[F.when(F.col("kind") == "story", F.col(c)) for c in ("y", "x")], "frame_ix"]
    return _by_place(_placements(frames, _PLACE), story_first)


def chain_starts(frames: DataFrame) -> DataFrame:
    """Adds ``is_start``: a story's text frame that no frame of the document precedes."""
    ids = frames.where("self_id <> ''").select("doc_id", F.col("self_id").alias("prev_frame")).distinct().withColumn("_known", F.lit(True))
    text = (F.col("kind") == "text") & (F.col("story_id") != "")
    joined = frames.join(ids, ["doc_id", "prev_frame"], "left")
    return joined.withColumn("is_start", text & ((F.col("prev_frame") == "") | F.col("_known").isNull())).drop("_known")


def threaded(frames: DataFrame) -> DataFrame:
    """A story stands where its chain of frames starts; stories without a start, where their first frame is."""
    placed = _placements(chain_starts(frames), [F.col("is_start").desc(), *_PLACE])
    found = [F.when((F.col("kind") == "story") & F.col("is_start"), 0).otherwise(1), "y", "x", "frame_ix"]
    return _by_place(placed, found)


def story_order(frames: DataFrame, order: DataFrame) -> DataFrame:
    """``order(doc_id, story_id, story_ix)`` decides; unlisted stories follow, images come last."""
    placed = _placements(frames, ["frame_ix"])
    ranks = order.groupBy("doc_id", "story_id").agg(F.max("story_ix").alias("story_ix"))
    placed = placed.join(ranks, ["doc_id", "story_id"], "left")
    rank = F.when(F.col("kind") == "image", 10_001).otherwise(F.coalesce("story_ix", F.lit(10_000)))
    return renumber(placed, ["doc_id"], [rank, "frame_ix"], "placement_ix").select(*_COLS)


def auto(frames: DataFrame) -> DataFrame:
    """Threaded for documents with threads, else geometric, document by document in one plan."""
    linked = (F.col("kind") == "text") & ((F.col("next_frame") != "") | (F.col("prev_frame") != ""))
    flagged = chain_starts(frames).withColumn("is_threaded", F.max(linked).over(W.partitionBy("doc_id")))
    placed = _placements(flagged, [(F.col("is_threaded") & F.col("is_start")).desc(), *_PLACE])
    story = F.col("kind") == "story"
    first = F.when(F.col("is_threaded"), F.when(story & F.col("is_start"), 0).otherwise(1)).otherwise(F.when(story, 0).otherwise(1))
    keep = F.col("is_threaded") | story
    return _by_place(placed, [first, F.when(keep, F.col("y")), F.when(keep, F.col("x")), "frame_ix"])


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"auto": auto, "geometric": geometric, "threaded": threaded, "story_order": story_order}


def place(frames: DataFrame, strategy: str = "auto", order: DataFrame | None = None) -> DataFrame:
    """``frames`` to ``placements`` by the named strategy; unknown names mean ``auto``."""
    chosen = STRATEGIES.get((strategy or "auto").lower(), auto)
    if chosen is story_order:
        if order is None:
            order = frames.sparkSession.createDataFrame([], "doc_id string, story_id string, story_ix int")
        return story_order(frames, order)
    return chosen(frames)
