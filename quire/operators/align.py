"""Alignment with a second source: print positions and recovered visuals."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.similarity import ratio
from quire.functions.text import match_norm

from .folds import fold

PREFIX = 35
LEAST = 8
_BACK, _AHEAD = 8, 350
#: A place that is not known: neither before nor after any other.
_NONE = float("nan")


def containment(needle: Column, candidate: Column, forward: float = 1.0, backward: float = 0.92) -> Column:
    """The score of a prefix of one text found in the other; null if neither."""
    return F.when(F.contains(candidate, F.substring(needle, 1, PREFIX)), forward).when(F.contains(needle, F.substring(candidate, 1, PREFIX)), backward)


#: Items that are looked for in one scan of the texts; their automaton is broadcast.
PASSAGE_BLOCK = 20_000


def contained_passages(docs: DataFrame, items: DataFrame, block: int = PASSAGE_BLOCK) -> DataFrame:
    """(doc_id, item_id, whole): the texts that hold an item's first PREFIX characters; ``whole``: all of it.

    ``docs(doc_id, norm)`` and ``items(item_id, item)`` are in the form of :func:`match_norm`; shorter items match
    nothing. Items are the query set: blocks of them, as automata, meet all texts in a scan; texts are not shuffled.
    """
    spark, n = docs.sparkSession, PREFIX

    def scan(block_: list[tuple[int, str]]) -> DataFrame:
        told = spark.sparkContext.broadcast(block_)

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by_prefix: dict[str, list[tuple[int, str]]] = {}
            for item_id, item in told.value:
                by_prefix.setdefault(item[:n], []).append((item_id, item))
            automaton = ahocorasick.Automaton()
            for prefix, owners in by_prefix.items():
                automaton.add_word(prefix, owners)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc_id, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    seen = {id(owners): owners for _, owners in automaton.iter(norm)} if norm else {}
                    rows += [(doc_id, item_id, item in norm) for owners in seen.values() for item_id, item in owners]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], ["doc_id", "item_id", "whole"])

        return docs.select(F.col("doc_id").cast("long"), "norm").mapInArrow(find, "doc_id long, item_id long, whole boolean")

    out, held = None, []
    rows = items.where(F.length("item") >= n).select(F.col("item_id").cast("long").alias("item_id"), "item")
    for r in rows.toLocalIterator():  # a block at a time
        held.append((r.item_id, r["item"]))
        if len(held) == block:
            out = scan(held) if out is None else out.unionByName(scan(held))
            held = []
    if held:
        out = scan(held) if out is None else out.unionByName(scan(held))
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, whole boolean")


def _letters(text: str) -> dict[str, int]:
    """Where each character of ``text`` stands, as bits."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    return at


def _ceiling(at: dict[str, int], n: int, other: str) -> float:
    """No less than the matching ratio with ``other`` of a text of ``n`` characters: its blocks are a common subsequence."""
    v = full = (1 << n) - 1
    for c in other:
        u = v & at.get(c, 0)
        v = (v + u | v - u) & full
    return 2.0 * (n - v.bit_count()) / (n + len(other)) if n + len(other) else 1.0


def most_alike(text: str, others: list[tuple[int, str]], threshold: float, best: float = 0.0, at: int = -1, swap: bool = False) -> tuple[float, int]:
    """(score, place) of the other text with the greatest matching ratio, of equal ones the least place; beats ``best``, ``at``.

    Ratios below ``threshold`` do not count. The ratio is computed only where its ceiling leaves it a chance, greatest
    ceiling first. ``swap``: the other text is the first argument of the ratio.
    """
    letters = _letters(text)
    open_ = sorted(((-_ceiling(letters, len(text), other), i, other) for i, other in others), key=lambda x: x[:2])
    for top, i, other in open_:
        if -top < threshold or -top < best:
            break
        if -top == best and 0 <= at < i:
            continue
        s = ratio(other, text) if swap else ratio(text, other)
        if s >= threshold and s > 0 and (s > best or s == best and not 0 <= at < i):
            best, at = s, i
    return best, at


def _best_candidate(needle: str, norms: list[str], low: int, high: int, threshold: float) -> tuple[float, int]:
    """(score, place) of the candidate in [low, high) that scores best, of equal ones the first; (0, -1) if none comes to ``threshold``.

    A prefix of the text in the candidate is 1, the candidate's prefix in the text 0.92, else it is their matching ratio.
    """
    probe = needle[:120]
    start = probe[:PREFIX]
    for i in range(low, high):
        if start in norms[i]:
            return (1.0, i) if threshold <= 1.0 else (0.0, -1)
    held = {i for i in range(low, high) if norms[i][:PREFIX] in needle}
    best, at = (0.92, min(held)) if held and threshold <= 0.92 else (0.0, -1)
    return most_alike(probe, [(i, norms[i][:120]) for i in range(low, high) if i not in held], threshold, best, at)


def align_positions(blocks: DataFrame, pdf_blocks: DataFrame, threshold: float = 0.55, spread_unmatched: bool = True) -> DataFrame:
    """Blocks with the page and y of the best matching candidate near a cursor that only moves on.

    Each match moves the window of the next, so this is a fold per document; a block looks at no more than 358
    candidates. Blocks left unmatched are spread over the candidates in proportion (``spread_unmatched``); tables stand
    just under the text before them. Blocks and candidates meet in one exchange.
    """

    def one(rows: list[tuple]) -> Iterator[tuple]:
        mine, cand = ([(i, *r[2:]) for i, r in enumerate(rows) if r[1] == side] for side in (0, 1))
        cand = [r for r in cand if len(r[2]) >= LEAST]  # here, as a filter would norm each text twice
        norms = [r[2] for r in cand]
        total, cursor, seen, above = sum(r[1] == "text" for r in mine), 0, -1, None
        for i, kind, needle, page, y in mine:
            if kind == "text":
                seen += 1
                best, at = _best_candidate(needle, norms, max(0, cursor - _BACK), min(len(norms), cursor + _AHEAD), threshold) if len(needle) >= LEAST else (0.0, -1)
                matched = best >= threshold and at >= 0
                cursor = max(cursor, at) if matched else cursor
                if not matched:
                    at = min(len(norms) - 1, round(seen * (len(norms) - 1) / (total - 1))) if spread_unmatched and needle and norms and total > 1 else -1
                # an unmatched block that already has a page keeps it
                if at >= 0 and (matched or page == 0 and cand[at][3] is not None):
                    page, y = cand[at][3:]
                above = (page, y)
            elif kind == "table" and above:
                page, y = above[0], None if above[1] is None else above[1] + 0.1
            yield page, y, i

    text = F.col("block_kind") == "text"
    rest = [c for c in blocks.columns if c not in ("page", "y")]
    row = F.struct(*rest).alias("_row")
    own = blocks.select("doc_id", F.lit(0).alias("_side"), "block_kind", F.when(text, match_norm(F.col("text"))).alias("_norm"), "page", "y", F.col("order_key").alias("_at"), F.lit(None).cast("int").alias("_then"), row)
    norm = pdf_blocks.select("doc_id", F.lit(1).alias("_side"), F.lit(None).cast("string").alias("block_kind"), match_norm(F.col("text")).alias("_norm"), "page", F.col("y0").alias("y"), F.col("page").alias("_at"), F.col("block_ix").alias("_then"), F.lit(None).cast(own.schema["_row"].dataType).alias("_row"))
    both = own.unionByName(norm)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    out = fold(both, ["_side", "_at", "_then"], one, f"page {kinds['page']}, y {kinds['y']}", ["_side", "block_kind", "_norm", "page", "y"], ["_row"])
    return out.select(*(F.col(c) if c in ("page", "y") else F.col(f"_row.{c}") for c in blocks.columns))


def anchor_score(target: str, texts: list[tuple[int, str]], before: bool, threshold: float = 0.42) -> tuple[int, float] | None:
    """(order_key, score): the text, of those (order_key, text), that is most like an anchor; None below ``threshold``.

    Both are in the form of :func:`match_norm`; of equal scores the first block wins.
    """
    if len(target) < 12:
        return None
    target = target[-1200:] if before else target[:1200]
    best, at, open_ = 0.0, -1, []
    for key, text in texts:
        if len(text) < LEAST:
            continue
        if text[:PREFIX] in target:
            s = 1.0 + min(len(text), 200) / 1000.0
        elif target[:PREFIX] in text:
            s = 0.95
        else:
            open_.append((key, text[:180]))
            continue
        if s > best or s == best and key < at:
            best, at = s, key
    if open_ and best <= 1.0:
        best, at = most_alike(target[-220:] if before else target[:220], open_, threshold, best, at, swap=True)
    return (at, best) if at >= 0 and best >= threshold else None


#: What a chapter's end says, which its picture says again.
FINISHER_TEXT = r"(?i)chapter complete|scan qr to challenge|make your own part test"


def finisher_duplicate() -> Column:
    """Whether a block says again what a finisher picture says: its words, or the QR image."""
    qr = (F.col("block_kind") == "image") & F.contains(F.lower(F.replace(F.concat_ws(" ", "alt", "original_ref"), F.lit(" "), F.lit(""))), F.lit("qrcode"))
    said = (F.col("block_kind") == "text") & F.col("text").rlike(FINISHER_TEXT)
    return F.coalesce(qr | said, F.lit(False))


def recover_visuals(blocks: DataFrame, visuals: DataFrame) -> DataFrame:
    """Recovered pictures among the blocks: openers first, finishers last, figures by table, anchor, or position.

    Where a finisher was recovered, its words and the QR image go. Anchors are scored against the text blocks of their
    page. Each picture sees those before it, so this is a fold per document; blocks and pictures meet in one exchange.
    """

    def one(rows: list[tuple]) -> Iterator[tuple]:
        mine, pics = ([(i, *r[2:]) for i, r in enumerate(rows) if r[1] == side] for side in (0, 1))
        ends = any(p[2] == "finisher" for p in pics)
        line: list[dict] = []
        texts: dict[int, list[tuple[int, str]]] = {}
        for i, key, kind, page, y, src, blanks, twice, norm, _ in mine:
            if not (ends and twice):
                line.append({"order_key": key, "block_kind": kind, "page": _NONE if page is None else page, "y": y, "src": src, "blanks": blanks, "_row": i, "visual_ix": None})
                if kind == "text" and page is not None:
                    texts.setdefault(page, []).append((key, norm))
        for i, ix, kind, page, y, src, _, _, before, after in pics:
            texts_here, page, y = texts.get(page, []), _NONE if page is None else page, _NONE if y is None else y
            p = {"kind": kind, "page": page, "y0": y, "long_before": len(before) >= 120, "before_key": None, "before_score": None, "after_key": None, "after_score": None}
            if kind not in ("opener", "finisher"):
                for side, said in (("before", before), ("after", after)):
                    if found := anchor_score(said, texts_here, side == "before"):
                        p[f"{side}_key"], p[f"{side}_score"] = found
            line = insert_visual(line, p, {"order_key": None, "visual_ix": ix, "block_kind": "image", "page": page, "y": y, "src": src, "blanks": 0, "_row": i})
        for place, r in enumerate(line):
            yield place, r["_row"], r["_row"]

    none = lambda kind: F.lit(None).cast(kind)
    blanks = F.aggregate(F.flatten(F.coalesce("grid", F.array())), F.lit(0), lambda n, c: n + F.when(F.trim(c["text"]) == "", 1).otherwise(0))
    own = blocks.select(
        "doc_id", F.lit(0).alias("_side"), F.col("order_key").alias("_at"), F.col("block_kind").alias("_kind"), F.col("page").alias("_page"), F.col("y").alias("_y"), F.col("src").alias("_src"), blanks.alias("_blanks"), finisher_duplicate().alias("_twice"),
        F.when(F.col("block_kind") == "text", match_norm(F.col("text"))).alias("_one"), none("string").alias("_two"), F.struct(*blocks.columns).alias("_block"), none(visuals.select(F.struct(*visuals.columns).alias("v")).schema["v"].dataType).alias("_visual"),
    )
    new = visuals.select(
        "doc_id", F.lit(1).alias("_side"), F.col("visual_ix").alias("_at"), F.col("kind").alias("_kind"), F.col("page").alias("_page"), F.col("y0").alias("_y"), F.col("src").alias("_src"), F.lit(0).alias("_blanks"), F.lit(False).alias("_twice"),
        match_norm(F.col("anchor_before")).alias("_one"), match_norm(F.col("anchor_after")).alias("_two"), none(own.schema["_block"].dataType).alias("_block"), F.struct(*visuals.columns).alias("_visual"),
    )
    look = ["_side", "_at", "_kind", "_page", "_y", "_src", "_blanks", "_twice", "_one", "_two"]
    out = fold(own.unionByName(new), ["_side", "_at"], one, "new_key int", look, ["_block", "_visual"])
    v, empty = F.col("_visual"), F.lit("")
    alt = F.when(v["kind"] == "opener", "chapter opener").when(v["kind"] == "finisher", "chapter finisher").otherwise("figure")
    made = {
        "block_kind": F.lit("image"), "type": F.lit("image"), "col": F.lit(0), "x": F.lit(0.0), "y": v["y0"], "story_id": empty, "frame_id": empty, "box_group": F.lit(0), "box_kind": empty,
        "anchored": F.lit(False), "ex_label": F.lit(False), "text": empty, "original_ref": F.concat(F.lit("pdf:p"), v["page"].cast("string")), "alt": alt, "width": v["width_px"], "height": v["height_px"], "latex": empty, "fallback_image": empty,
    }

    def cell(c: str) -> Column:
        kind = blocks.schema[c].dataType
        if c == "order_key":
            return F.col("new_key").cast(kind).alias(c)
        of_visual = made[c] if c in made else v[c] if c in visuals.columns else F.lit(None)
        return F.when(v.isNotNull(), of_visual.cast(kind)).otherwise(F.col("_block")[c]).alias(c)

    return out.select(*map(cell, blocks.columns))


def _place_of(line: list[dict], key) -> int | None:
    return None if key is None or key != key else next((i for i, r in enumerate(line) if r["order_key"] == key), None)


def insert_visual(line: list[dict], p: dict, new: dict) -> list[dict]:
    """The line with one picture more: first, last, or where its neighbours say."""
    if p["kind"] in ("opener", "finisher"):
        return [new, *line] if p["kind"] == "opener" else [*line, new]
    away = lambda r: abs(float(r["y"] or 0) - p["y0"])
    here = lambda r: r["page"] == p["page"]
    gap = min(((away(r), i) for i, r in enumerate(line) if r["block_kind"] == "image" and not r["src"] and here(r)), default=None)
    if gap and gap[0] < 100:  # an unresolved picture makes room
        line = line[: gap[1]] + line[gap[1] + 1 :]
    table = min(((away(r), i) for i, r in enumerate(line) if r["block_kind"] == "table" and here(r) and r["blanks"] >= 2 and away(r) < 260), default=None)
    before, after = _place_of(line, p["before_key"]), _place_of(line, p["after_key"])
    score = lambda s: 0.0 if s is None or s != s else s
    if table:
        at = table[1]
    elif before is not None and (p["long_before"] or score(p["before_score"]) >= 0.55 or score(p["before_score"]) >= score(p["after_score"])):
        at = before + 1
    elif after is not None:
        at = after
    else:
        own = [i for i, r in enumerate(line) if here(r)]
        lower = [i for i in own if float(line[i]["y"] or 0) >= p["y0"]]
        beyond = [i for i, r in enumerate(line) if r["page"] > p["page"]]
        at = lower[0] if lower else own[-1] + 1 if own else beyond[0] if beyond else len(line)
    return [*line[:at], new, *line[at:]]
