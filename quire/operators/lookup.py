"""Lookups: pages by position, graphics by name, equations by basename."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.latex import needs_own_line
from quire.functions.mathml import mathml_latex
from quire.functions.text import file_name, link_key, safe_stem, strip, unquote

from .sequence import first_per_key

COPIED = ("png", "jpg", "jpeg", "gif", "webp")
RASTERISED = ("tif", "tiff", "bmp", "eps", "wmf", "emf")
EXTERNAL = ("cdr", "svg", "ai", "pdf")


def nearest_box(points: DataFrame, boxes: DataFrame, keys: list[str], cx: Column, cy: Column, carry: list[str]) -> DataFrame:
    """Each point with ``carry`` of the first box that holds it, else of the box of the nearest centre.

    ``boxes``: keys, box_ix, x_offset, y_offset, width, height. A spread's boxes are few, so the join fans out little; the
    best box is chosen by an aggregate, not a sort.
    """
    points = points.withColumns({"_cx": cx, "_cy": cy, "_pid": F.monotonically_increasing_id()})
    b = boxes.select(*keys, F.col("box_ix").alias("_ix"), F.struct(*carry, "x_offset", "width").alias("_box"), *[F.col(c).alias("_" + c) for c in ("x_offset", "y_offset", "width", "height")])
    inside = F.col("_cx").between(F.col("_x_offset"), F.col("_x_offset") + F.col("_width")) & F.col("_cy").between(F.col("_y_offset"), F.col("_y_offset") + F.col("_height"))
    dx, dy = F.col("_cx") - (F.col("_x_offset") + F.col("_width") / 2), F.col("_cy") - (F.col("_y_offset") + F.col("_height") / 2)
    rank = F.struct((~inside).alias("out"), F.when(inside, 0.0).otherwise(dx * dx + dy * dy).alias("d"), F.col("_ix"))
    joined = points.join(b, keys, "left")
    own = [c for c in points.columns if c not in keys and c != "_pid"]
    out = joined.groupBy(*keys, "_pid").agg(*[F.first(c).alias(c) for c in own], F.min_by("_box", rank).alias("_box"))
    return out.drop("_pid")


def assign_pages(frames: DataFrame, pages: DataFrame) -> DataFrame:
    """Frames with page_index, page_name and col: the right column from the page's middle on."""
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    boxes = pages.withColumn("box_ix", F.col("page_index")).withColumn("page_name", F.col("name"))
    out = nearest_box(frames, boxes, ["doc_id", "spread_ix"], cx, cy, ["page_index", "page_name"])
    middle = F.col("_box.x_offset") + F.col("_box.width") / 2
    return out.withColumns({
        "page_index": F.coalesce("_box.page_index", F.col("page_base").cast("int")), "page_name": F.coalesce("_box.page_name", F.lit("")),
        "col": F.when(F.col("_cx") >= middle, 1).otherwise(0),
    }).drop("_box", "_cx", "_cy")


def equation_lookup(refs: DataFrame, equations: DataFrame, ref: str = "ref") -> DataFrame:
    """``refs`` with latex and display of the equation of their basename, or nulls. Later equal basenames count."""
    keyed = refs.withColumn("_key", link_key(F.col(ref)))
    return keyed.join(equations.withColumnRenamed("basename", "_key"), "_key", "left").drop("_key")


def planned_method(ext: Column) -> Column:
    """How a graphic of this extension becomes web-safe."""
    return F.when(ext.isin(*COPIED), "copy").when(ext.isin(*RASTERISED), "pillow").when(ext.isin(*EXTERNAL), "external").otherwise("unsupported")


def resolve_assets(refs: DataFrame, links: DataFrame, folders: DataFrame | None = None, outcomes: DataFrame | None = None, images: str = "images") -> DataFrame:
    """``assets``: one row for each distinct (doc_id, link_uri) of ``refs``.

    ``links(doc_id, name, path)`` are the files; a name is found exactly or else without regard to case and outer
    space (of several, the least by name). ``folders(doc_id)`` lists documents that have a folder of links (default: those
    with a file). ``outcomes(path, ok)`` says what conversion did; without it the planned method is taken to work for
    extensions that are copied, and everything else is found but unconverted.
    """
    refs = refs.groupBy("doc_id", "link_uri").agg(F.min("first_ix").alias("first_ix")) if "first_ix" in refs.columns else refs.select("doc_id", "link_uri").distinct().withColumn("first_ix", F.lit(0))
    refs = refs.withColumn("name", file_name(unquote(F.col("link_uri"))))
    exact = links.groupBy("doc_id", "name").agg(F.min("path").alias("exact_path"))
    fuzzy = first_per_key(links.withColumn("key", F.lower(strip(F.col("name")))), ["doc_id", "key"], ["name", "path"]).select("doc_id", "key", F.col("path").alias("fuzzy_path"))
    have = (folders if folders is not None else links).select("doc_id").distinct().withColumn("has_folder", F.lit(True))
    out = refs.join(exact, ["doc_id", "name"], "left").withColumn("key", F.lower(strip(F.col("name")))).join(fuzzy, ["doc_id", "key"], "left").join(have, "doc_id", "left")
    out = out.withColumn("path", F.coalesce("exact_path", "fuzzy_path")).withColumn("ext", F.lower(F.when(F.contains(F.col("path"), F.lit(".")), F.substring_index("path", ".", -1)).otherwise("")))
    out = out.withColumn("method", F.when(F.col("path").isNotNull(), planned_method(F.col("ext"))).otherwise(""))
    if outcomes is not None:
        out = out.join(outcomes.select("path", "ok"), "path", "left")
    else:
        out = out.withColumn("ok", F.col("method") == "copy")
    ok = F.coalesce("ok", F.lit(False)) & F.col("path").isNotNull()
    target = F.concat(F.lit(images + "/"), safe_stem(F.col("name")), F.lit("."), F.when(F.col("method") == "copy", F.col("ext")).otherwise("png"))
    note = F.when(F.col("has_folder").isNull(), "No Links folder").when(F.col("path").isNull(), "Link file not found").when(F.col("method") == "unsupported", F.concat(F.lit("Unhandled format: ."), F.col("ext"))).otherwise("")
    return out.select(
        "doc_id", F.col("link_uri").alias("original_ref"), F.col("name").alias("original_name"), F.col("path").isNotNull().alias("found"),
        (ok & (F.col("method") != "copy")).alias("converted"), "method", F.when(ok, target).otherwise("").alias("output_rel"), note.alias("note"), "first_ix", "path",
    )


def inline_images(blocks: DataFrame, equations: DataFrame, assets: DataFrame, payloads: DataFrame | None = None, sizes: DataFrame | None = None, dpi: float = 600.0) -> DataFrame:
    """Graphics inside texts: the equation's LaTeX, else the LaTeX within the file, else its image.

    ``payloads(doc_id, original_ref, content)`` are the linked files, ``sizes(doc_id, output_rel, width, height)`` pixel
    sizes of converted ones. Each distinct reference is resolved once, then joined to its runs. Only references
    without an equation reach the parser of file contents.
    """
    # texts without a graphic stay as they are, and out of the joins
    graphic = F.coalesce(F.exists("runs", lambda r: r["is_image"] & (r["original_ref"] != "")), F.lit(False))
    plain, blocks = blocks.where(~graphic), blocks.where(graphic)
    refs = blocks.select("doc_id", F.explode("runs").alias("r")).where("r.is_image and r.original_ref <> ''").select("doc_id", F.col("r.original_ref").alias("ref")).distinct()
    known = equation_lookup(refs, equations)
    hit = known.where("latex is not null").select("doc_id", "ref", "latex", F.coalesce("display", F.lit(False)).alias("tall"))
    rest = known.where("latex is null").select("doc_id", "ref")
    if payloads is not None:
        inner = rest.join(payloads.withColumnRenamed("original_ref", "ref"), ["doc_id", "ref"], "left").withColumn("latex", mathml_latex(F.col("content")))
        inner = inner.select("doc_id", "ref", F.when(F.col("latex") != "", F.col("latex")).alias("latex"))
    else:
        inner = rest.withColumn("latex", F.lit(None).cast("string"))
    image = inner.join(assets.where("found and output_rel <> ''").select("doc_id", F.col("original_ref").alias("ref"), F.col("output_rel").alias("src"), F.col("original_name").alias("alt")), ["doc_id", "ref"], "left")
    if sizes is not None:
        image = image.join(sizes.select("doc_id", F.col("output_rel").alias("src"), "width", "height"), ["doc_id", "src"], "left")
    else:
        image = image.withColumns({"width": F.lit(0.0), "height": F.lit(0.0)})
    lat = F.col("latex").isNotNull()
    shape = F.coalesce((F.col("width") > 0) & (F.col("height") > 0) & (F.col("height") / F.col("width") >= 0.45), F.lit(False))
    image = image.select(
        "doc_id", "ref", F.coalesce("latex", F.lit("")).alias("latex"), F.when(lat, needs_own_line(F.col("latex"))).otherwise(shape).alias("tall"),
        F.when(lat, "").otherwise(F.coalesce("src", F.lit(""))).alias("src"), F.when(lat, "").otherwise(F.coalesce("alt", F.lit(""))).alias("alt"),
        F.when(lat | F.coalesce(F.col("height") <= 0, F.lit(True)), 0.0).otherwise(F.bround(F.col("height") * 96.0 / dpi, 1)).alias("max_h_px"),
    )
    found = hit.select("doc_id", "ref", "latex", "tall", F.lit("").alias("src"), F.lit("").alias("alt"), F.lit(0.0).alias("max_h_px")).unionByName(image)
    runs = blocks.select("doc_id", "order_key", F.posexplode("runs").alias("ix", "r"))
    runs = runs.join(found.withColumnRenamed("doc_id", "d"), (F.col("doc_id") == F.col("d")) & (F.col("r.original_ref") == F.col("ref")) & F.col("r.is_image"), "left")
    new = F.col("r")
    for f in ("latex", "tall", "src", "alt", "max_h_px"):
        new = new.withField(f, F.coalesce(F.col(f), F.col("r." + f)))
    again = runs.select("doc_id", "order_key", F.struct("ix", new.alias("r")).alias("x")).groupBy("doc_id", "order_key").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["r"]).alias("_runs"))
    out = blocks.join(again, ["doc_id", "order_key"], "left")
    return plain.unionByName(out.withColumn("runs", F.coalesce("_runs", "runs")).select(*blocks.columns))


def present_and_missing(refs: DataFrame, files: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Distinct referenced names that have a file, and those that have none."""
    names = refs.select(*keys).distinct()
    return names.join(files, keys, "left_semi"), names.join(files, keys, "left_anti")


#: Font families of the output and the stems that serve them, with weight and style.
FONT_ALIASES = (
    ("BodySerif", r"minionpro-regular|^times$", "normal", "normal"),
    ("BodySerif", r"minion.*bold|bold.*minion|^timesbd$", "700", "normal"),
    ("BodySerif", r"minion.*italic|italic.*minion|^timesi$", "normal", "italic"),
    ("HeadingSans", r"graphik-regular|^helvetica_0$", "normal", "normal"),
    ("HeadingSans", r"graphik-bold|graphik-black", "700", "normal"),
)


def font_faces(fonts: DataFrame) -> DataFrame:
    """(doc_id, face_ix, family, rel, weight, style) from ``fonts(doc_id, name)``: each file's face, then the aliases."""
    f = fonts.where(F.lower("name").rlike(r"\.(ttf|otf|ttc)$")).withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", "")).withColumn("low", F.lower("stem"))
    rel = F.concat(F.lit("fonts/"), F.col("name"))
    weight = F.when(F.col("low").rlike("bold|black|blk"), "700").otherwise("normal")
    style = F.when(F.col("low").rlike("italic|oblique"), "italic").otherwise("normal")
    own = f.select("doc_id", F.lit(0).alias("part"), "name", F.col("stem").alias("family"), rel.alias("rel"), weight.alias("weight"), style.alias("style"))
    for i, (family, pattern, w, s) in enumerate(FONT_ALIASES, 1):
        one = first_per_key(f.where(F.col("low").rlike(pattern)), ["doc_id"], ["name"])
        own = own.unionByName(one.select("doc_id", F.lit(i).alias("part"), "name", F.lit(family).alias("family"), rel.alias("rel"), F.lit(w).alias("weight"), F.lit(s).alias("style")))
    from .sequence import renumber

    return renumber(own, ["doc_id"], ["part", "name"], "face_ix").select("doc_id", "face_ix", "family", "rel", "weight", "style")
