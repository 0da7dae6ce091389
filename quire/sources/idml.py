"""Package parts to records. Sibling order matters and Spark's XML reader groups siblings by tag, so parts are walked
in Python, part by part, in parallel; everything after that is columns."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from quire import schema
from quire.functions.geometry import bounding_box
from quire.staging import cut

from .packages import last_of_each, spreads, stories

_GRAPHICS = frozenset("Rectangle Polygon Oval GraphicLine Group Image EPS WMF PDF ImportedPage TextFrame".split())
_SHAPES = ("Rectangle", "Polygon", "Oval", "GraphicLine")
_GLYPHS = {"mt extra": str.maketrans("\uf06c\uf083\uf051", "l\u21ccC"), "symbol": {0xF8E7: None}}
_GLYPHS["mt extra tiger"] = _GLYPHS["mt extra"]


def _parsed(parts: DataFrame, walk: Callable[[str, str, ET.Element], Iterator[dict]], ddl: str) -> DataFrame:
    """Rows that ``walk`` finds in each part. Parts that are not well-formed give none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for doc_id, name, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part_name", "body"))):
                try:
                    root = ET.fromstring(body)
                except ET.ParseError:
                    continue
                rows += walk(doc_id, name, root)
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return parts.select("doc_id", "part_name", "body").mapInArrow(run, ddl)


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def tidy(text: str, font: str = "", compat: bool = False) -> str:
    """A content's text: symbol glyphs, damaged encodings and separators put right."""
    text = text.translate(_GLYPHS.get(font.lower(), {}))
    if any(c in text for c in "\u00c2\u00c3\u00e2") or compat and "?" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            pass
    for sep in ("\u2028", "\u2029", *(("???",) if compat else ())):
        text = text.replace(sep, "\n")
    return re.sub(" {2,}", " ", text.replace("\t", " "))


def _style(applied: str | None) -> str:
    return (applied or "").rpartition("/")[2].replace("$ID/", "").strip()


def _face(csr: ET.Element) -> dict:
    weight, position = (csr.get("FontStyle") or "").lower(), (csr.get("Position") or "").lower()
    return {
        "bold": any(x in weight for x in ("bold", "black")),
        "italic": any(x in weight for x in ("italic", "oblique")),
        "superscript": "superscript" in position,
        "subscript": "subscript" in position,
    }


_PLAIN = {"text": "", "bold": False, "italic": False, "superscript": False, "subscript": False, "char_style": "", "font": "", "point_size": 0.0, "image_uri": "", "textframe_story": "", "grid": None}


def _runs(csr: ET.Element, started: bool, compat: bool) -> Iterator[dict]:
    font = next((e.text for e in csr.iter() if _local(e) == "AppliedFont" and e.text), "")
    look = _face(csr) | {"char_style": _style(csr.get("AppliedCharacterStyle")), "font": font, "point_size": float(csr.get("PointSize") or 0)}
    for node in csr:
        tag, new = _local(node), []
        if tag == "Content":
            text = tidy(node.text or "", font, compat)
            new = [look | {"text": text}] if text else []
        elif tag == "Br":
            new = [{"text": "\n"}] if started else []
        elif tag == "Table":
            grid = table_grid(node, compat)
            new = [{"grid": grid}] if grid else []
        elif tag in _GRAPHICS:
            boxes = dict.fromkeys(e.get("ParentStory") for e in node.iter("TextFrame") if e.get("ParentStory"))
            uri = next((e.get("LinkResourceURI") for e in node.iter("Link")), None)
            new = [{"textframe_story": b} for b in boxes] or ([{"image_uri": uri}] if uri else [])
        for r in new:
            started = True
            yield _PLAIN | r


def _cell(cell: ET.Element, compat: bool) -> tuple[str, str]:
    plain, rich = [], []
    for csr in cell.iter("CharacterStyleRange"):
        face = _face(csr)
        # contents of this range alone: those of ranges inside it come with their own
        for content in (e for e in csr if _local(e) == "Content" and e.text) if not compat else (e for e in csr.iter("Content") if e.text):
            text = tidy(content.text, compat=compat).replace("\n", " ")
            plain.append(text)
            mark = "sub" if face["subscript"] else "sup" if face["superscript"] else ""
            piece = escape(text, quote=False)
            piece = f"<{mark}>{piece}</{mark}>" if mark else piece
            rich.append(f"<strong>{piece}</strong>" if face["bold"] else piece)
    return tuple(re.sub(r"\s{2,}", " ", "".join(x)).strip() for x in (plain, rich))  # type: ignore[return-value]


def table_grid(table: ET.Element, compat: bool = False) -> list[list[dict]]:
    """Rows of cells. Cells are named ``column:row``; spans cover places, and places without a cell are empty ones."""
    cells: dict[tuple[int, int], dict] = {}
    for c in table.findall("Cell"):
        found = re.match(r"\s*([+-]?\d+)\s*:\s*([+-]?\d+)\s*(?::|$)", c.get("Name") or "")
        if found:
            text, rich = _cell(c, compat)
            cells[int(found[2]), int(found[1])] = {"text": text, "html": rich, "colspan": int(float(c.get("ColumnSpan") or 1)), "rowspan": int(float(c.get("RowSpan") or 1))}
    if not cells:
        return []
    height = 1 + max(r + x["rowspan"] - 1 for (r, _), x in cells.items())
    stated = table.get("ColumnCount") or "0"
    width = max(int(stated) if stated.isdigit() else 0, 1 + max(c + x["colspan"] - 1 for (_, c), x in cells.items()))
    taken: set[tuple[int, int]] = set()
    rows = []
    for r in range(height):
        row = []
        for c in range(width):
            if (r, c) in taken:
                continue
            cell = cells.get((r, c), {"text": "", "html": "", "colspan": 1, "rowspan": 1})
            taken |= {(y, x) for y in range(r, r + cell["rowspan"]) for x in range(c, c + cell["colspan"])} | {(r, c)}
            row.append(cell)
        if row:
            rows.append(row)
    return rows


def paragraphs(parts: DataFrame, compat: bool = False) -> DataFrame:
    """``paragraphs`` of all stories. Of parts that give the same story, the last by name counts."""

    def walk(doc_id: str, name: str, root: ET.Element) -> Iterator[dict]:
        story = next(root.iter("Story"), None) if _local(root) != "Story" or root.tag.startswith("{") else root
        if story is None:
            return
        story_id = story.get("Self", re.sub(r"\.[^.]*$", "", name.rpartition("/")[2]))
        ix = 0
        for psr in story.findall("ParagraphStyleRange"):
            runs: list[dict] = []
            for csr in psr.findall("CharacterStyleRange"):
                runs += _runs(csr, bool(runs), compat)
            if runs:
                yield {"doc_id": doc_id, "story_id": story_id, "part_name": name, "para_ix": ix, "para_style": _style(psr.get("AppliedParagraphStyle")), "runs": runs}
                ix += 1

    return last_of_each(_parsed(stories(parts), walk, schema.PARAGRAPHS), ["doc_id", "story_id"], "part_name")


def spread_order(parts: DataFrame) -> DataFrame:
    """(doc_id, part_name, spread_ix): the map's order; by name for packages whose map lists none."""

    def walk(doc_id: str, name: str, root: ET.Element) -> Iterator[dict]:
        sources = [e.get("src") or "" for e in root.iter() if _local(e) == "Spread"]
        for ix, found in enumerate(m[0] for m in (re.search(r"Spread_[^/]+\.xml", s) for s in sources) if m):
            yield {"doc_id": doc_id, "part_name": "Spreads/" + found, "spread_ix": ix}

    listed = _parsed(parts.where("part_name = 'designmap.xml'"), walk, "doc_id string, part_name string, spread_ix int")
    have = spreads(parts).select("doc_id", "part_name")
    by_name = have.join(listed.select("doc_id").distinct(), "doc_id", "left_anti")
    by_name = by_name.withColumn("spread_ix", F.row_number().over(W.partitionBy("doc_id").orderBy("part_name")) - 1)
    return listed.join(have, ["doc_id", "part_name"], "left_semi").unionByName(by_name.select("doc_id", "part_name", "spread_ix"))


def story_order(parts: DataFrame) -> DataFrame:
    """(doc_id, story_id, story_ix) from the map's list."""

    def walk(doc_id: str, name: str, root: ET.Element) -> Iterator[dict]:
        for ix, s in enumerate((root.get("StoryList") or "").split()):
            yield {"doc_id": doc_id, "story_id": s, "story_ix": ix}

    return _parsed(parts.where("part_name = 'designmap.xml'"), walk, "doc_id string, story_id string, story_ix int")


def items(parts: DataFrame) -> DataFrame:
    """Page items of all spreads: pages, then text frames, then linked shapes by tag."""

    def walk(doc_id: str, name: str, root: ET.Element) -> Iterator[dict]:
        spread = next((e for e in root.iter("Spread")), None)
        if spread is None:
            return
        ordered = [("page", e) for e in spread.findall("Page")] + [("text", e) for e in spread.iter("TextFrame")]
        for tag in _SHAPES:
            ordered += [("image", e) for e in spread.iter(tag)]
        for ix, (kind, e) in enumerate(ordered):
            link = next(e.iter("Link"), None) if kind == "image" else None
            uri = link.get("LinkResourceURI", "") if link is not None else ""
            if kind == "image" and not uri:
                continue
            prefs = next(e.iter("TextFramePreference"), None)
            columns = int(float(prefs.get("TextColumnCount", "1") or 1)) if prefs is not None else 1
            yield {
                "doc_id": doc_id, "part_name": name, "item_ix": ix, "kind": kind, "self_id": e.get("Self", ""), "name": e.get("Name"), "bounds": e.get("GeometricBounds") or "",
                "transform": e.get("ItemTransform") or "", "story_id": e.get("ParentStory", ""), "column_count": columns, "prev_frame": e.get("PreviousTextFrame") or "",
                "next_frame": e.get("NextTextFrame") or "", "link_uri": uri,
            }

    return _parsed(spreads(parts), walk, schema.ITEMS)


def resources(parts: DataFrame) -> DataFrame:
    """(doc_id, kind, name): fonts, paragraph styles and character styles."""
    body = F.decode("body", "UTF-8")
    kinds = {"font": "FontFamily", "paragraph_style": "ParagraphStyle", "character_style": "CharacterStyle"}
    found = [parts.where(F.col("part_name").rlike(r"^Resources/.*\.xml$")).select("doc_id", F.lit(k).alias("kind"), F.explode(F.xpath(body, F.lit(f"//{t}/@Name"))).alias("name")) for k, t in kinds.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


def layout(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pages`` and ``frames`` of all packages, in document order, with frames placed on their pages."""
    from quire.operators.lookup import assign_pages
    from quire.operators.sequence import running_before

    # parsed once: three tables come from it
    all_ = cut(items(parts).join(spread_order(parts), ["doc_id", "part_name"]), "items").withColumn("r", bounding_box(F.col("bounds"), F.col("transform")))
    counts = all_.groupBy("doc_id", "spread_ix").agg(F.count_if(F.col("kind") == "page").alias("n"))
    base = running_before(counts, ["doc_id"], ["spread_ix"], "n", "page_base").drop("n")
    all_ = all_.join(base, ["doc_id", "spread_ix"])
    pages = all_.where("kind = 'page'").withColumn("page_index", (F.col("page_base") + F.col("item_ix")).cast("int"))
    pages = pages.select("doc_id", "spread_ix", "self_id", F.coalesce("name", (F.col("page_index") + 1).cast("string")).alias("name"), "page_index", F.col("r.width").alias("width"), F.col("r.height").alias("height"), F.col("r.x").alias("x_offset"), F.col("r.y").alias("y_offset"))
    frames = all_.where("kind <> 'page'").select("doc_id", "spread_ix", "item_ix", "page_base", "self_id", "kind", "story_id", "r.*", "column_count", "prev_frame", "next_frame", "link_uri")
    placed = assign_pages(frames, pages)
    w = W.partitionBy("doc_id").orderBy("spread_ix", "item_ix")
    placed = placed.withColumn("frame_ix", F.row_number().over(w) - 1)
    cols = [c.split()[0] for c in schema.FRAMES.split(", ")]
    return pages.drop("spread_ix"), placed.select(*cols)
