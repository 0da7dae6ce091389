"""Registered queries over blocks: every document of the driver's table carries a small, fixed layout that the library's
own operators work on; what must come out of it is said in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schema
from quire.config import MobileProfile
from quire.functions import html as H
from quire.functions import latex, mathml, similarity, text
from quire.operators import align, classify, coverage, grouping, layout, lookup, qa, render, sections
from quire.sources import idml, packages

from .catalogue import _LINES, _long, _query, _t

def _d() -> Column:
    return F.col("doc_id").cast("string")



def _say(fmt: str) -> Column:
    """``fmt`` with the document's id for {d}."""
    return F.replace(F.lit(fmt), F.lit("{d}"), _d())


def _said(column: str, key: str = "doc_id") -> str:
    return f"replace({column}, '{{d}}', {key}::VARCHAR)"


def _run(said: str = "", **flags) -> Column:
    base = {"text": _say(said), "bold": False, "italic": False, "superscript": False, "subscript": False, "char_style": "", "is_image": False, "src": "", "original_ref": "", "alt": "", "tall": False, "max_h_px": 0.0, "latex": ""} | flags
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in base.items()])


def _blocks(docs: DataFrame, rows: list[dict]) -> DataFrame:
    """The layout ``rows`` for each document, as blocks in order. ``when``: which documents have the row."""
    fields = [f.split(" ", 1) for f in schema.BLOCKS.replace(f"array<{schema.RUN}>", "RUNS").replace(schema.GRID, "GRID").split(", ")]
    made = []
    for i, row in enumerate(rows):
        said = row.get("text", "")
        base = {"order_key": i, "block_kind": "text", "type": "paragraph", "page": 0, "col": 0, "x": 0.0, "y": float(10 * i), "story_id": "s", "frame_id": "", "box_group": 0, "box_kind": "", "anchored": False, "ex_label": False, "src": "", "original_ref": "", "alt": "", "width": 0.0, "height": 0.0, "latex": "", "display": True, "fallback_image": "", "grid": None}
        base |= row | {"text": _say(said), "runs": F.array(*row.get("runs", [_run(said)]))}
        when = base.pop("when", None)
        cells = []
        for name, kind in fields[1:]:
            v = base[name]
            v = v if isinstance(v, Column) else _say(v) if isinstance(v, str) else F.lit(v)
            cells.append(v.cast({"RUNS": f"array<{schema.RUN}>", "GRID": schema.GRID}.get(kind, kind)).alias(name))
        made.append(F.struct(*cells) if when is None else F.when(F.col("doc_id") % when[0] == when[1], F.struct(*cells)))
    out = docs.select(_d().alias("id"), "doc_id").select("id", F.explode(F.array(*made)).alias("b")).where("b is not null")
    return out.select(F.col("id").alias("doc_id"), "b.*")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id")


def _values(*rows: tuple) -> str:
    """SQL rows; a last member (k, r) tells which documents have the row."""
    quote = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(quote(v) for v in r) + ")" for r in rows) + ")"


# -- grouping ----------------------------------------------------------------------------------------------------------

_GROUPS = [
    {"type": "question", "text": "Q1. What is {d}?"},
    {"text": "Ex-5"},
    {"type": "solution", "text": "Sol. working", "when": (3, 0)},
    {"text": "a body of words", "anchored": True},
    {"text": "Key Note", "anchored": True, "when": (2, 0)},
    {"type": "question", "text": "1. first"},
    {"type": "question", "text": "2. second", "when": (5, 1)},
    {"text": "Check Your Understanding"},
    {"type": "question", "text": "3. third"},
    {"type": "heading", "text": "Next {d}"},
]


def _grouped_sql(order: list[int], boxes: dict[int, tuple[int, str]]) -> str:
    rows = [(i, _GROUPS[k]["text"], *boxes.get(k, (0, "")), *_GROUPS[k].get("when", (1, 0))) for i, k in enumerate(order)]
    return f"""SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS order_key, {_said('t')} AS text, box::BIGINT AS box_group, kind AS box_kind
FROM documents, {_values(*rows)} v(i, t, box, kind, k, r) WHERE doc_id % k = r"""


def _grouped(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("order_key").cast("long").alias("order_key"), "text", F.col("box_group").cast("long").alias("box_group"), "box_kind")


_CALLOUT = {3: (1, "callout"), 4: (1, "callout")}
_EXAMPLE = _CALLOUT | dict.fromkeys((0, 1, 2), (2, "example"))


@_query(_grouped_sql([0, 1, 2, 4, 3, 5, 6, 7, 8, 9], _CALLOUT))
def anchored_boxes(spark, sf_dir):
    """Runs of anchored blocks become callouts, labels first."""
    return _grouped(grouping.merge_anchored(_blocks(_docs(spark, sf_dir), _GROUPS)))


@_query(_grouped_sql([1, 0, 2, 4, 3, 5, 6, 7, 8, 9], _EXAMPLE))
def worked_examples(spark, sf_dir):
    """A ribbon's box takes the question before it and the answer after it."""
    return _grouped(grouping.group_examples(grouping.merge_anchored(_blocks(_docs(spark, sf_dir), _GROUPS))))


@_query(_grouped_sql([1, 0, 2, 4, 3, 7, 5, 6, 8, 9], _EXAMPLE | dict.fromkeys((5, 6, 7, 8), (3, "questions"))))
def question_headers(spark, sf_dir):
    """A header found after its questions moves before them."""
    b = grouping.group_examples(grouping.merge_anchored(_blocks(_docs(spark, sf_dir), _GROUPS)))
    return _grouped(grouping.hoist_question_headers(b))


_LABELS = ["Key Note", "Do you  know", "remember this one", "Ex-5", "ex. 12", "Ex 7 and many words after it", "notes", ""]


@_query(f"""SELECT doc_id, {_said("['Key Note', 'Do you  know', 'remember this one', 'Ex-5', 'ex. 12', 'Ex 7 and many words after it', 'notes', ''][doc_id % 8 + 1]")} AS label,
  doc_id % 8 < 5 AS callout, doc_id % 8 IN (3, 4) AS example FROM documents""")
def label_shapes(spark, sf_dir):
    """Labels of callouts and of examples."""
    d = _docs(spark, sf_dir).withColumn("label", F.element_at(F.array(*map(F.lit, _LABELS)), (F.col("doc_id") % 8 + 1).cast("int")))
    return d.select("doc_id", "label", classify.is_callout_label(F.col("label")).alias("callout"), classify.is_ex_label(F.col("label")).alias("example"))


# -- rendering ---------------------------------------------------------------------------------------------------------

_CELL = "struct<text:string,html:string,colspan:int,rowspan:int>"


def _cell(said: str, html: str = "", colspan: int = 1, rowspan: int = 1) -> Column:
    return F.struct(F.lit(said).alias("text"), F.lit(html).alias("html"), F.lit(colspan).alias("colspan"), F.lit(rowspan).alias("rowspan"))


def _grid() -> Column:
    return F.array(F.array(_cell("A<", colspan=2), _cell("B")), F.array(_cell("c", "<b>c</b>"), _cell("d"), _cell("", rowspan=2)))

def _page() -> list[dict]:
    return [
        {"type": "chapter_title", "text": "Title {d}"},
        {"type": "heading", "text": "Part one"},
        {"text": "Speaker: words of {d}"},
        {"type": "list_item", "text": "Label: a < b"},
        {"type": "list_item", "text": "plain"},
        {"type": "question", "text": "Q2. Why?"},
        {"type": "question", "text": "and why not?"},
        {"type": "heading", "text": "Key note"},
        {"text": "Exercise"},
        {"block_kind": "image", "type": "image", "src": "images/{d}.png", "alt": "chapter opener", "runs": []},
        {"block_kind": "math", "type": "math_display", "latex": "x^{2}", "runs": []},
        {"block_kind": "math", "type": "math_display", "latex": "", "fallback_image": "m.png", "runs": []},
        {"block_kind": "table", "type": "table", "grid": _grid(), "runs": []},
        {"type": "heading", "text": "Part two"},
        {"type": "heading", "text": "Part  Two"},
        {"type": "subpoint", "text": "a point"},
        {"text": "ex  -5", "ex_label": True, "box_group": 1, "box_kind": "example"},
        {"text": "inside", "box_group": 1, "box_kind": "example"},
        {"text": "", "runs": [_run(is_image=True, src="i.png", original_ref="i.wmf", max_h_px=20.4)]},
    ]

_HTML = [
    "",
    '<h2 class="heading">Part one</h2>\n',
    '<paragraph id="{id}" class="para"><span class="speaker">Speaker:</span> words of {d}</paragraph>\n',
    '<ul class="bullets">\n<li><strong>Label:</strong> a &lt; b</li>\n',
    "<li>plain</li>\n",
    '</ul>\n<paragraph id="{id}" class="question"><span class="qnum">Q2.</span> Why?</paragraph>\n',
    '<paragraph id="{id}" class="qcont">and why not?</paragraph>\n',
    '<h3 class="callout-head kn">Key note</h3>\n',
    '<h3 class="qsection-head">Exercise</h3>\n',
    '<figure class="opener"><img src="images/{d}.png" alt="chapter opener" loading="lazy" decoding="async"></figure>\n',
    '<div class="math-display" data-latex="x^{2}">\\[x^{2}\\]</div>\n',
    '<figure class="math-display"><img src="m.png" alt="equation"></figure>\n',
    '<div class="table-wrap"><table class="tbl"><tr><th colspan="2">A&lt;</th><th>B</th></tr><tr><td><b>c</b></td><td>d</td><td rowspan="2"></td></tr></table></div>\n',
    '<h2 class="heading">Part two</h2>\n',
    '<div class="sublabel">Part  Two</div>\n',
    '<paragraph id="{id}" class="subpoint">a point</paragraph>\n',
    '<div class="box example">\n<div class="ex-ribbon">Ex -5</div>\n',
    '<paragraph id="{id}" class="para">inside</paragraph>\n',
    '</div>\n<figure class="math-display"><img class="block-eqn" src="i.png" alt="equation" style="max-height:20px"></figure>\n',
]


def _titles(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).select(_d().alias("doc_id"), _say("Title {d}").alias("title"))


_RENDERED = f"SELECT doc_id::VARCHAR AS doc_id, i::BIGINT AS order_key, replace({_said('h')}, '{{id}}', substr(sha256(doc_id::VARCHAR || '|' || i::VARCHAR), 1, 32)) AS html FROM documents, {_values(*enumerate(_HTML))} v(i, h)"


@_query(_RENDERED)
def block_render(spark, sf_dir):
    """Each kind of block as HTML, with list and box edges, a title left out, a heading repeated."""
    b = sections.section_blocks(_blocks(_docs(spark, sf_dir), _page()))
    return render.rendered_blocks(b, _titles(spark, sf_dir)).select("doc_id", F.col("order_key").cast("long").alias("order_key"), "html")


_SECTION_OF = "CASE WHEN order_key = 0 THEN 1 WHEN order_key < 7 THEN 2 WHEN order_key < 13 THEN 3 WHEN order_key = 13 THEN 4 ELSE 5 END"


@_query(f"""WITH r AS ({_RENDERED}), s AS (SELECT doc_id, {_SECTION_OF} AS s, '<section class="sec">' || chr(10) || string_agg(html, '' ORDER BY order_key) || '</section>' || chr(10) AS h FROM r GROUP BY 1, 2)
SELECT doc_id, sha256('<main class="doc">' || chr(10) || '<h1 class="doc-title">Title ' || doc_id || '</h1>' || chr(10) || string_agg(h, '' ORDER BY s) || '</main>' || chr(10) || '</body>' || chr(10) || '</html>' || chr(10)) AS body_sha256 FROM s GROUP BY doc_id""")
def page_document(spark, sf_dir):
    """whole pages, from the opening of their body on."""
    out = render.render(sections.section_blocks(_blocks(_docs(spark, sf_dir), _page())), _titles(spark, sf_dir))
    return out.select("doc_id", F.sha2(F.expr("substr(html, locate('<main', html))"), 256).alias("body_sha256"))


@_query("""SELECT doc_id, '<strong>A ' || doc_id || ' &amp; b</strong>H<sub>2</sub><em><sup>n</sup></em><br>' || CASE doc_id % 4
  WHEN 0 THEN '<span class="math-inline" data-latex="x">\\(x\\)</span>' WHEN 1 THEN '<span class="math-inline-block" data-latex="y">\\[y\\]</span>' WHEN 2 THEN '<img class="inline-eqn" src="e.png" alt="a">' ELSE '' END AS html FROM documents""")
def inline_html(spark, sf_dir):
    """styled runs and graphics inside a text."""
    k = F.col("doc_id") % 4
    image = _run(is_image=True, latex=F.when(k == 0, "x").when(k == 1, "y").otherwise(""), tall=(k == 1), src=F.when(k == 2, "e.png").otherwise(""), alt="a")
    runs = F.array(_run("A {d} & b", bold=True), _run("H"), _run("2", subscript=True), _run("n", superscript=True, italic=True), _run("\n"), image)
    return _docs(spark, sf_dir).select("doc_id", H.inline(runs).alias("html"))


# -- checks, statistics, titles ----------------------------------------------------------------------------------------


def _checked() -> list[dict]:
    return [
        {"type": "heading", "text": "Start"},
        {"block_kind": "math", "latex": F.when(F.col("doc_id") % 3 == 0, "{x").otherwise("x"), "runs": []},
        {"block_kind": "image", "src": F.when(F.col("doc_id") % 4 == 0, "").otherwise("images/a.png"), "runs": []},
        {"text": "t", "runs": [_run("t"), _run(is_image=True, original_ref="e.WMF", latex=F.when(F.col("doc_id") % 5 == 0, "").otherwise("x"))]},
        {"type": "heading", "text": " ", "runs": [], "when": (6, 0)},
    ]



@_query("""WITH d AS (SELECT doc_id FROM documents), r AS (
SELECT doc_id, 'required_files' AS chk, doc_id % 2 <> 0 AS ok, true AS err, false AS skipped, CASE WHEN doc_id % 2 <> 0 THEN '{"missing":[]}' ELSE '{"missing":["css/styles.css"]}' END AS detail FROM d
UNION ALL SELECT doc_id, 'min_font_size', true, true, false, '{"body":15,"min":13}' FROM d UNION ALL SELECT doc_id, 'page_width_contract', true, false, false, '{"page_width":360,"safe_width":328}' FROM d
UNION ALL SELECT doc_id, 'math_well_formed', doc_id % 3 <> 0, false, false, CASE WHEN doc_id % 3 <> 0 THEN '{"broken":[]}' ELSE '{"broken":["{x"]}' END FROM d
UNION ALL SELECT doc_id, 'images_linked', doc_id % 4 <> 0 AND doc_id % 7 <> 0, false, false, CASE WHEN doc_id % 4 = 0 THEN '{"missing":["(no ref)"]}' WHEN doc_id % 7 = 0 THEN '{"missing":["images/a.png"]}' ELSE '{"missing":[]}' END FROM d
UNION ALL SELECT doc_id, 'inline_equations_resolved', doc_id % 5 <> 0, false, false, CASE WHEN doc_id % 5 = 0 THEN '{"unresolved":1}' ELSE '{"unresolved":0}' END FROM d
UNION ALL SELECT doc_id, 'no_empty_sections', doc_id % 6 <> 0, false, false, CASE WHEN doc_id % 6 = 0 THEN '{"empty":["(untitled)"]}' ELSE '{"empty":[]}' END FROM d
UNION ALL SELECT doc_id, 'assets_found', doc_id % 8 <> 0, false, false, CASE WHEN doc_id % 8 = 0 THEN '{"missing":["a.png"]}' ELSE '{"missing":[]}' END FROM d
UNION ALL SELECT doc_id, 'assets_converted', doc_id % 8 <> 1, false, false, CASE WHEN doc_id % 8 = 1 THEN '{"unconverted":["a.png"]}' ELSE '{"unconverted":[]}' END FROM d
UNION ALL SELECT doc_id, 'tables_covered', doc_id % 9 <> 0, false, false, CASE WHEN doc_id % 9 = 0 THEN '{"source":2,"rendered":1}' ELSE '{"source":1,"rendered":1}' END FROM d
UNION ALL SELECT doc_id, n, true, e, true, NULL FROM d, (VALUES ('horizontal_overflow', true), ('no_clipped_images', false), ('no_broken_images', true), ('katex_rendered_ok', true)) v(n, e))
SELECT doc_id::VARCHAR AS doc_id, chk AS "check", ok, err AS is_error, skipped, detail FROM r""")
def qa_rules(spark, sf_dir):
    """Every rule over documents that break some of them."""
    ids = _docs(spark, sf_dir)
    docs = ids.select(_d().alias("doc_id"))
    b = _blocks(ids, _checked())
    files = ids.select(_d().alias("id"), "doc_id", F.explode(F.array(*map(F.lit, ("index.html", "css/styles.css", "images/a.png")))).alias("rel"))
    files = files.where(~((F.col("rel") == "css/styles.css") & (F.col("doc_id") % 2 == 0)) & ~((F.col("rel") == "images/a.png") & (F.col("doc_id") % 7 == 0))).select(F.col("id").alias("doc_id"), "rel")
    assets = ids.select(_d().alias("doc_id"), F.lit(0).alias("first_ix"), F.lit("a.png").alias("original_name"), (F.col("doc_id") % 8 != 0).alias("found"), F.when(F.col("doc_id") % 8 == 1, "").otherwise("images/a.png").alias("output_rel"))
    cover = ids.select(_d().alias("doc_id"), F.lit(1).alias("tables"), F.when(F.col("doc_id") % 9 == 0, 2).otherwise(1).alias("src_tables"))
    sectioned = sections.section_blocks(b)
    rules = [
        qa.required_files(docs, files), qa.profile_checks(docs, MobileProfile()), qa.math_well_formed(docs, b), qa.images_linked(docs, b, files), qa.equations_resolved(docs, b),
        qa.no_empty_sections(docs, sectioned, sections.sections(sectioned)), qa.asset_checks(assets), qa.tables_covered(cover), qa.dynamic_checks(docs),
    ]
    return qa.report(rules)



def _counted() -> list[dict]:
    return [
        {"type": "heading", "text": "One two"},
        {"text": "three {d}", "page": 1, "runs": [_run("three {d}"), _run(is_image=True, original_ref="e.wmf", latex="x"), _run(is_image=True, original_ref="f.emf")]},
        {"block_kind": "table", "runs": [], "page": 1, "when": (4, 0)},
        {"block_kind": "image", "src": "images/p.png", "original_ref": "pdf:p1", "runs": [], "page": 2, "when": (3, 0)},
        {"text": "boxed", "box_group": 2, "box_kind": "callout"},
    ]



@_query("""SELECT doc_id::VARCHAR AS doc_id, 18 + length(doc_id::VARCHAR) AS characters, 5::BIGINT AS words, 3::BIGINT AS text_blocks, 2::BIGINT AS equations, (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS tables, 1::BIGINT AS sections,
  ceil((18 + length(doc_id::VARCHAR)) / 4.0)::BIGINT AS tokens, (1 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS images_placed, (2 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS pages FROM documents""")
def block_statistics(spark, sf_dir):
    """All statistics of documents with tables, pictures and equations."""
    b = _blocks(_docs(spark, sf_dir), _counted())
    out = coverage.statistics(b, sections.sections(sections.section_blocks(b)))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("characters", "words", "text_blocks", "equations", "tables", "sections", "tokens", "images_placed", "pages")))


def _raw(said: str = "", image: str = "", grid: Column | None = None, frame: str = "") -> Column:
    cells = {"text": said, "bold": False, "italic": False, "superscript": False, "subscript": False, "char_style": "", "font": "", "point_size": 11.0, "image_uri": image, "textframe_story": frame}
    return F.struct(*[F.lit(v).alias(k) for k, v in cells.items()], (F.array().cast(schema.GRID) if grid is None else grid).alias("grid"))


@_query("""SELECT doc_id::VARCHAR AS doc_id, (CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS src_tables, 1::BIGINT AS src_images, 1::BIGINT AS src_frames, (CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END)::BIGINT AS tables,
  2::BIGINT AS equations, 1::BIGINT AS equations_resolved, (CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS figures, 1::BIGINT AS boxes, CASE WHEN doc_id % 4 = 0 THEN 50.0::DOUBLE ELSE 0.0::DOUBLE END AS tables_pct, 50.0::DOUBLE AS equations_pct FROM documents""")
def source_coverage(spark, sf_dir):
    """A1, A2: what the source refers to against what came out."""
    ids = _docs(spark, sf_dir)
    runs = F.array(_raw("a"), _raw(grid=_grid()), _raw(image="x.png"), _raw(frame="u1"))
    more = F.when(F.col("doc_id") % 2 == 0, F.array(_raw(grid=_grid()))).otherwise(F.array().cast(f"array<{schema.RAW_RUN}>"))
    paras = ids.select(_d().alias("doc_id"), F.concat(runs.cast(f"array<{schema.RAW_RUN}>"), more.cast(f"array<{schema.RAW_RUN}>")).alias("runs"))
    out = coverage.coverage(paras, _blocks(ids, _counted()))
    names = ("src_tables", "src_images", "src_frames", "tables", "equations", "equations_resolved", "figures", "boxes")
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in names), F.col("tables_pct").cast("double").alias("tables_pct"), F.col("equations_pct").cast("double").alias("equations_pct"))


@_query("""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 4 = 0 THEN 'Pure Waters' WHEN doc_id % 4 = 1 THEN 'Chapter ' || doc_id WHEN doc_id % 4 = 2 THEN 'Pure Water' ELSE 'Document' END AS title FROM documents""")
def title_guess(spark, sf_dir):
    """A heading that is the file's name, else a chapter title, else the file's name."""
    ids = _docs(spark, sf_dir)
    b = _blocks(ids, [{"type": "heading", "text": "Something else"}, {"type": "heading", "text": "Pure Waters", "when": (4, 0)}, {"type": "chapter_title", "text": "Chapter {d}", "when": (4, 1)}])
    stem = F.when(F.col("doc_id") % 4 == 3, "").otherwise("12-pure_water")
    return sections.documents(b, ids.select(_d().alias("doc_id"), stem.alias("stem"))).select("doc_id", "title")


@_query("SELECT (CASE WHEN count(*) = 0 THEN 1 ELSE max(CASE WHEN quality = 1 THEN 0 ELSE 2 END) END)::BIGINT AS rc FROM labels")
def batch_code(spark, sf_dir):
    """A batch's return code."""
    rc = _t(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, 0).otherwise(2).alias("rc"))
    return coverage.batch_code(rc).select(F.col("rc").cast("long").alias("rc"))


# -- alignment and visuals ---------------------------------------------------------------------------------------------


@_query(f"""SELECT doc_id::VARCHAR AS doc_id, para_ix::BIGINT AS order_key, (para_ix // 5)::BIGINT AS page, (para_ix % 5 * 10)::DOUBLE AS y FROM {_LINES}""")
def align_lines(spark, sf_dir):
    """Lines found again in a second source of the same lines, by a cursor that only moves on."""
    from quire.sources import text as source

    lines = source.lines(_t(spark, sf_dir, "documents")).select("doc_id", F.col("para_ix").cast("int").alias("ix"), F.concat(F.lit("paragraph "), F.col("para_ix").cast("string"), F.lit(" says "), F.col("text")).alias("text"))
    b = lines.select(_d().alias("doc_id"), F.col("ix").alias("order_key"), F.lit("text").alias("block_kind"), "text", F.lit(0).alias("page"), F.lit(0.0).alias("y"))
    pdf = lines.select(_d().alias("doc_id"), F.floor(F.col("ix") / 5).cast("int").alias("page"), (F.col("ix") % 5).alias("block_ix"), (F.col("ix") % 5 * 10).cast("double").alias("y0"), F.upper("text").alias("text"))
    out = align.align_positions(b, pdf)
    return out.select("doc_id", F.col("order_key").cast("long").alias("order_key"), F.col("page").cast("long").alias("page"), "y")


_ANCHORED = [{"text": "the first words that stand on this page of {d}"}, {"text": "another text of some length stands below them"}, {"text": "chapter complete", "page": 1}, {"block_kind": "image", "alt": "QR code", "src": "q.png", "runs": [], "page": 1}]


@_query(f"""SELECT doc_id::VARCHAR AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::BIGINT AS order_key, kind AS block_kind, {_said('what')} AS what FROM documents,
  {_values((0, "image", "chapter opener", 1, 0), (1, "text", "the first words that stand on this page of {d}", 1, 0), (2, "image", "figure", 2, 0), (3, "text", "another text of some length stands below them", 1, 0), (4, "image", "figure", 2, 1), (5, "image", "chapter finisher", 1, 0))} v(i, kind, what, k, r) WHERE doc_id % k = r""")
def recovered_visuals(spark, sf_dir):
    """Recovered pictures among the blocks; the finisher's words and QR image go."""
    ids = _docs(spark, sf_dir)
    visual = lambda ix, kind, page, y0, before, after: F.struct(F.lit(ix).alias("visual_ix"), F.lit(page).alias("page"), F.lit(y0).alias("y0"), F.lit(f"v{ix}.png").alias("src"), F.lit(10.0).alias("width_px"), F.lit(10.0).alias("height_px"), F.lit(kind).alias("kind"), before.alias("anchor_before"), after.alias("anchor_after"))
    none, even = F.lit(""), F.col("doc_id") % 2 == 0
    # of even documents the figure has the text before it for an anchor; of odd ones its place alone
    rows = F.array(visual(0, "opener", 0, 0.0, none, none), visual(1, "figure", 0, 99.0, F.when(even, _say("The first words that stand on this page of {d}.")).otherwise(none), none), visual(2, "finisher", 1, 0.0, none, none))
    visuals = ids.select(_d().alias("id"), F.explode(rows).alias("v")).select(F.col("id").alias("doc_id"), "v.*")
    out = align.recover_visuals(_blocks(ids, _ANCHORED), visuals)
    what = F.when(F.col("block_kind") == "image", F.col("alt")).otherwise(F.col("text"))
    return out.select("doc_id", F.col("order_key").cast("long").alias("order_key"), "block_kind", what.alias("what"))


@_query(f"""WITH l AS (SELECT *, para_ix // 10 AS page, (para_ix % 10) * 50.0 AS y FROM {_LINES}), f AS (SELECT doc_id, min(CASE WHEN length(text) > 120 THEN y END) AS lim FROM l WHERE page = 0 GROUP BY doc_id),
o AS (SELECT doc_id, 0 AS page, 0.0 AS y0, coalesce(lim, 300.0) AS y1, 'opener' AS kind FROM f), e AS (SELECT doc_id, page, greatest(0.0, min(y) - 8) AS y0, 600.0 AS y1, 'finisher' AS kind FROM l WHERE contains(lower(text), 'and') GROUP BY doc_id, page)
SELECT doc_id, page::BIGINT AS page, y0::DOUBLE AS y0, y1::DOUBLE AS y1, kind FROM (SELECT * FROM o WHERE y1 >= 60 UNION ALL SELECT * FROM e)""")
def page_ends(spark, sf_dir):
    """Opener and finisher bands of pages."""
    from quire.sources import text as source

    lines = source.lines(_t(spark, sf_dir, "documents"))
    pdf = lines.select("doc_id", F.floor(F.col("para_ix") / 10).cast("int").alias("page"), (F.col("para_ix") % 10 * 50.0).alias("y0"), "text")
    pages = pdf.select("doc_id", "page").distinct().withColumns({"width": F.lit(400.0), "height": F.lit(600.0)})
    both = layout.opener(pdf, pages).withColumn("kind", F.lit("opener")).unionByName(layout.finishers(pdf, pages, "AND").withColumn("kind", F.lit("finisher")))
    return both.select("doc_id", F.col("page").cast("long").alias("page"), "y0", F.col("y1").cast("double").alias("y1"), "kind")


@_query("""WITH r AS (SELECT l_suppkey AS doc_id, l_linenumber AS page, l_partkey::DOUBLE AS y, l_discount::DOUBLE * 5 AS density, l_tax::DOUBLE * 3 AS colour FROM lineitem WHERE l_quantity > 10),
s AS (SELECT *, CASE WHEN lag(y) OVER w IS NULL OR y - lag(y) OVER w > 18 THEN 1 ELSE 0 END AS st FROM r WINDOW w AS (PARTITION BY doc_id, page ORDER BY y)), g AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, page ORDER BY y RANGE UNBOUNDED PRECEDING) AS b FROM s),
k AS (SELECT doc_id, page, b, min(y) AS y0, max(y) AS y1 FROM g GROUP BY doc_id, page, b HAVING max(y) - min(y) >= 20 AND avg(density) < 0.5 AND avg(colour) < 0.25),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY round_even(y0, 0), b) - 1 AS ix FROM k) SELECT doc_id, page::BIGINT AS page, ix::BIGINT AS visual_ix, y0, y1 FROM t WHERE ix < 20 AND page > 0 AND page <> 3""")
def figure_bands(spark, sf_dir):
    """S29, S30, P18, L2, U3, A18 (analogy): bands of figure rows, the first twenty of a page, but on pages that end."""
    li = _t(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page"), F.lit(0).alias("col"), F.col("l_partkey").cast("double").alias("y"), (F.col("l_quantity") > 10).alias("is_figure"), (F.col("l_discount").cast("double") * 5).alias("density"), (F.col("l_tax").cast("double") * 3).alias("colour"))
    ends = li.where("l_linenumber = 3").select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("page")).distinct()
    out = layout.figure_pages(layout.top_bands(layout.figure_bands(rows)), ends)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.col("visual_ix").cast("long").alias("visual_ix"), "y0", "y1")


@_query("""SELECT doc_id, page::BIGINT AS page, clip::BIGINT AS clip_ix, x0, x1 FROM documents, (VALUES (0, 0, 0.0::DOUBLE, 400.0::DOUBLE, 2), (1, 0, 0.0, 210.0, 0), (1, 1, 190.0, 400.0, 0), (1, 0, 0.0, 400.0, 1), (2, 0, 0.0, 400.0, 2)) v(page, clip, x0, x1, m) WHERE m = 2 OR doc_id % 2 = m""")
def column_clips(spark, sf_dir):
    """Two-column pages told by the words that cross their middle, and cut in two."""
    out, _ = _clips(spark, sf_dir)
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.col("clip_ix").cast("long").alias("clip_ix"), "x0", "x1")


def _clips(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    ids = _docs(spark, sf_dir)
    pages = ids.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page")).withColumns({"width": F.lit(400.0), "height": F.lit(600.0)})
    # on page 1 of even documents 25 words and 4 blocks stand on either side of 200; on the others all lie across
    two = (F.col("page") == 1) & (F.col("doc_id") % 2 == 0)
    left = F.col("i") % 2 == 0
    spans = lambda n: pages.select("doc_id", "page", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")).select("doc_id", "page", F.when(two & ~left, 232.0).otherwise(20.0).alias("x0"), F.when(two & left, 168.0).otherwise(380.0).alias("x1"))
    return layout.column_clips(pages, layout.gutters(spans(50), pages, spans(8))), pages


_TILES = """(SELECT doc_id, v.page, clip, 'images/page_' || lpad((v.page + 1)::VARCHAR, 3, '0') || '_' || (clip + 1) || '.jpg' AS src, w FROM documents, (VALUES (0, 0, 400.0::DOUBLE, 2), (1, 0, 210.0, 0), (1, 1, 210.0, 0), (1, 0, 400.0, 1), (2, 0, 400.0, 2)) v(page, clip, w, m) WHERE m = 2 OR doc_id % 2 = m)"""


@_query(f"SELECT doc_id, page::BIGINT AS page, clip::BIGINT AS clip_ix, src, 270.0::DOUBLE AS width_pt, round_even(600 * 270 / w, 6) AS height_pt FROM {_TILES}")
def facsimile_tiles(spark, sf_dir):
    """K8: the clips of pages as tiles of one width."""
    out = layout.facsimile_tiles(*_clips(spark, sf_dir))
    return out.select("doc_id", F.col("page").cast("long").alias("page"), F.col("clip_ix").cast("long").alias("clip_ix"), "src", "width_pt", F.bround("height_pt", 6).alias("height_pt"))


@_query(f"""SELECT doc_id, '<!doctype html><html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=360, initial-scale=1"><title>Facsimile</title><link rel="stylesheet" href="css/styles.css"></head><body>'
  || string_agg('<img src="' || src || '" alt="page tile ' || n || '" loading="lazy">', chr(10) ORDER BY n) || '</body></html>' AS html FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, clip) AS n FROM {_TILES}) GROUP BY doc_id""")
def facsimile_pages(spark, sf_dir):
    """K9: a document's tiles as one page."""
    return layout.facsimile_pages(_docs(spark, sf_dir), layout.facsimile_tiles(*_clips(spark, sf_dir)))


# -- lookups -----------------------------------------------------------------------------------------------------------


@_query("""SELECT p_partkey, CASE WHEN p_partkey % 50 < 25 THEN 'x_{' || (p_partkey % 50) || '}' END AS latex FROM part""")
def equation_lookup(spark, sf_dir):
    """Equations by the basename of their reference, whatever its case and escapes."""
    p = _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("file:Links/Eq%20"), (F.col("p_partkey") % 50).cast("string"), F.lit(".WMF")).alias("ref"))
    n = spark.range(25).select(F.concat(F.lit("eq "), F.col("id").cast("string"), F.lit(".wmf")).alias("basename"), F.concat(F.lit("x_{"), F.col("id").cast("string"), F.lit("}")).alias("latex"), F.lit(False).alias("display"))
    return lookup.equation_lookup(p, n).select("p_partkey", "latex")


@_query("""SELECT doc_id::VARCHAR AS doc_id, CASE doc_id % 4 WHEN 0 THEN 'latex:x' WHEN 1 THEN 'latex:\\frac{a}{b}' WHEN 2 THEN 'src:images/a.png|a.png' ELSE 'open:' END AS resolved FROM documents""")
def inline_resolve(spark, sf_dir):
    """A graphic in a text is its equation, else the LaTeX in its file, else its image."""
    ids = _docs(spark, sf_dir)
    ref = F.element_at(F.array(*map(F.lit, ("Links/e.wmf", "Links/m.wmf", "Links/a.png", "Links/none.emf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    b = _blocks(ids, [{"text": "t", "runs": [_run("t"), _run(is_image=True, original_ref=ref)]}])
    eq = spark.createDataFrame([("e.wmf", "x", False)], schema.EQUATIONS)
    payloads = ids.where("doc_id % 4 = 1").select(_d().alias("doc_id"), F.lit("Links/m.wmf").alias("original_ref"), F.encode(F.lit("\x01<math><mfrac><mi>a</mi><mi>b</mi></mfrac></math>"), "UTF-8").alias("content"))
    assets = ids.select(_d().alias("doc_id"), F.lit("Links/a.png").alias("original_ref"), F.lit("a.png").alias("original_name"), F.lit(True).alias("found"), F.lit("images/a.png").alias("output_rel"))
    r = F.col("runs")[1]
    out = lookup.inline_images(b, eq, assets, payloads)
    return out.select("doc_id", F.when(r["latex"] != "", F.concat(F.lit("latex:"), r["latex"])).when(r["src"] != "", F.concat(F.lit("src:"), r["src"], F.lit("|"), r["alt"])).otherwise("open:").alias("resolved"))


@_query("""SELECT n_name AS doc_id, i::BIGINT AS face_ix, family, 'fonts/' || f AS rel, w AS weight, s AS style FROM nation, (VALUES (0, 'Graphik-Bold', 'Graphik-Bold.ttf', '700', 'normal', 2), (1, 'MinionPro-It Italic', 'MinionPro-It Italic.otf', 'normal', 'italic', 2), (2, 'MinionPro-Regular', 'MinionPro-Regular.otf', 'normal', 'normal', 2),
  (3, 'BodySerif', 'MinionPro-Regular.otf', 'normal', 'normal', 2), (4, 'BodySerif', 'MinionPro-It Italic.otf', 'normal', 'italic', 2), (5, 'HeadingSans', 'Graphik-Bold.ttf', '700', 'normal', 2)) v(i, family, f, w, s, m)""")
def font_faces(spark, sf_dir):
    """Font files as faces, and the families that they serve."""
    names = F.explode(F.array(*map(F.lit, ("MinionPro-Regular.otf", "MinionPro-It Italic.otf", "Graphik-Bold.ttf", "readme.txt")))).alias("name")
    out = lookup.font_faces(_t(spark, sf_dir, "nation").select(F.col("n_name").alias("doc_id"), names))
    return out.withColumns(_long("face_ix"))


def _table_parts(docs: DataFrame) -> DataFrame:
    """Packages whose story has a paragraph, a table with merged cells, and a frame anchored in the text."""
    cell = lambda name, said, more="": f'<Cell Name="{name}" {more}><ParagraphStyleRange><CharacterStyleRange><Content>{said}</Content></CharacterStyleRange></ParagraphStyleRange></Cell>'
    table = '<Table ColumnCount="3">' + cell("0:0", "A{d}", 'ColumnSpan="2"') + cell("2:0", "B", 'RowSpan="2"') + cell("0:1", "C") + "</Table>"
    story = f'<S_><Story Self="u1"><ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/Body"><CharacterStyleRange PointSize="11"><Content>before</Content>{table}<TextFrame Self="f" ParentStory="u2"/></CharacterStyleRange></ParagraphStyleRange></Story></S_>'
    part = lambda n, b: F.struct(F.lit(n).alias("part_name"), F.encode(_say(b), "UTF-8").alias("body"))
    parts = F.array(part("designmap.xml", '<Document StoryList="u1"/>'), part("Stories/Story_u1.xml", story), part("Resources/Fonts.xml", '<F_><FontFamily Self="f" Name="Face {d}"/></F_>'), part("Resources/Styles.xml", '<F_><ParagraphStyle Self="b" Name="Body"/></F_>'), part("Stories/Story_bad.xml", "<no"))
    return docs.select(_d().alias("id"), F.explode(parts).alias("p")).select(F.col("id").alias("doc_id"), "p.*")


@_query("SELECT doc_id::VARCHAR AS doc_id, 'A' || doc_id || '|B/C|' AS cells, 2::BIGINT AS colspan, 2::BIGINT AS rowspan, 'u2' AS frame FROM documents")
def package_tables(spark, sf_dir):
    """A story's table as a grid with merged cells, and the frame anchored beside it."""
    runs = idml.paragraphs(_table_parts(_docs(spark, sf_dir))).select("doc_id", F.explode("runs").alias("r"))
    grid = F.first(F.when(F.size("r.grid") > 0, F.col("r.grid")), ignorenulls=True).alias("g")
    out = runs.groupBy("doc_id").agg(grid, F.max("r.textframe_story").alias("frame"))
    row = lambda r: F.array_join(F.transform(r, lambda c: c["text"]), "|")
    return out.select("doc_id", F.array_join(F.transform("g", row), "/").alias("cells"), F.col("g")[0][0]["colspan"].cast("long").alias("colspan"), F.col("g")[0][1]["rowspan"].cast("long").alias("rowspan"), "frame")


@_query("SELECT doc_id::VARCHAR AS doc_id, kind, replace(name, '{d}', doc_id::VARCHAR) AS name FROM documents, (VALUES ('font', 'Face {d}'), ('paragraph_style', 'Body')) v(kind, name)")
def package_resources(spark, sf_dir):
    """Fonts and styles that packages name."""
    return idml.resources(_table_parts(_docs(spark, sf_dir))).select("doc_id", "kind", "name")


@_query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'copy' WHEN 1 THEN 'pillow' WHEN 2 THEN 'external' WHEN 3 THEN 'unsupported' ELSE 'copy' END AS method FROM part""")
def graphic_methods(spark, sf_dir):
    """How a graphic becomes web-safe, by its extension."""
    ext = F.element_at(F.array(*map(F.lit, ("png", "wmf", "svg", "doc", "webp"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return _t(spark, sf_dir, "part").select("p_partkey", lookup.planned_method(ext).alias("method"))


@_query("""SELECT folder, count(*)::BIGINT AS packages, min(name) AS idml FROM (SELECT s_nationkey AS folder, 's' || s_suppkey || '.idml' AS name FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY folder""")
def package_folders(spark, sf_dir):
    """The folders of a listing that hold a package."""
    s = _t(spark, sf_dir, "supplier")
    ext = F.when(F.col("s_suppkey") % 3 == 0, "idml").otherwise("txt")
    folder = F.concat(F.lit("/in/"), F.col("s_nationkey").cast("string"))
    name = F.concat(F.lit("s"), F.col("s_suppkey").cast("string"), F.lit("."), ext)
    files = s.select(F.concat(folder, F.lit("/"), name).alias("path"), folder.alias("dir"), name.alias("name"), ext.alias("ext"), F.lit(1).alias("length"))
    n = files.where("ext = 'idml'").groupBy("dir").agg(F.count("*").alias("packages"))
    found = packages.discover(files).join(n, "dir")
    return found.select(F.substring_index("dir", "/", -1).cast("int").alias("folder"), "packages", F.substring_index("idml_file", "/", -1).alias("idml"))


# -- scalar functions --------------------------------------------------------------------------------------------------


@_query("SELECT p_partkey, trim(p_type) AS style FROM part")
def style_names(spark, sf_dir):
    """the last part of an applied style's path."""
    return _t(spark, sf_dir, "part").select("p_partkey", text.short_style(F.concat(F.lit("ParagraphStyle/Group/$ID/ "), "p_type", F.lit(" "))).alias("style"))


@_query("SELECT p_partkey, p_name || chr(10) || 'a b c' AS said, 'one two ' || p_partkey AS one FROM part")
def story_text(spark, sf_dir):
    """separators, tabs and runs of spaces in stories."""
    said = F.concat("p_name", F.lit(" a\tb  c"))
    return _t(spark, sf_dir, "part").select("p_partkey", text.tidy_story_text(said).alias("said"), text.collapse_spaces(F.concat(F.lit("  one   two "), F.col("p_partkey").cast("string"), F.lit("  "))).alias("one"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'l' || chr(8652) || 'C' || chr(63719) WHEN p_partkey % 3 = 1 THEN chr(61548) || chr(61571) || chr(61521) ELSE chr(61548) || chr(61571) || chr(61521) || chr(63719) END AS said FROM part")
def symbol_glyphs(spark, sf_dir):
    """private-use glyphs of symbol fonts."""
    k = F.col("p_partkey") % 3
    font = F.when(k == 0, "MT Extra").when(k == 1, "Symbol").otherwise("Arial")
    return _t(spark, sf_dir, "part").select("p_partkey", text.symbol_text(F.lit(""), font).alias("said"))


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice::DOUBLE AS price, CASE WHEN q < 60 THEN format('{:.1f}s', q) ELSE format('{}m {:02d}s', round_even(q, 0)::BIGINT // 60, round_even(q, 0)::BIGINT % 60) END AS took FROM (SELECT *, l_quantity::DOUBLE * 7.25 AS q FROM lineitem)")
def durations(spark, sf_dir):
    """elapsed time as people read it."""
    li = _t(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("double").alias("price"), text.duration(F.col("l_quantity").cast("double") * 7.25).alias("took"))


_ESCAPED = "s"
for _k, _v in latex.SYMBOLS.items():
    _ESCAPED = f"replace({_ESCAPED}, '{_k}', '{_v + ' ' if _v.startswith(chr(92)) else _v}')"


@_query(f"SELECT p_partkey, {_ESCAPED} AS escaped FROM (SELECT p_partkey, p_name || ' × ' || p_partkey || '° ≤ α→β' AS s FROM part)")
def symbol_latex(spark, sf_dir):
    """symbols as LaTeX commands."""
    said = F.concat("p_name", F.lit(" × "), F.col("p_partkey").cast("string"), F.lit("° ≤ α→β"))
    return _t(spark, sf_dir, "part").select("p_partkey", latex.escape_symbols(said).alias("escaped"))


@_query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'y = \\frac{3}{' || p_size || '}' WHEN 1 THEN 'H_{2}O^{' || p_size || '}' WHEN 2 THEN 'x \\leq {' || p_size ELSE NULL END AS latex, CASE p_partkey % 4 WHEN 2 THEN false WHEN 3 THEN NULL ELSE true END AS confident FROM part""")
def run_latex(spark, sf_dir):
    """Runs that look like mathematics, or have scripts, as LaTeX."""
    p = _t(spark, sf_dir, "part").withColumns({"doc_id": F.col("p_size"), "k": F.col("p_partkey") % 4})
    runs = F.when(F.col("k") == 0, F.array(_run("y =  3 / {d}"))).when(F.col("k") == 1, F.array(_run("H"), _run("2 ", subscript=True), _run("O"), _run("{d}", superscript=True))).when(F.col("k") == 2, F.array(_run("x ≤ {{d}"))).otherwise(F.array(_run("plain words")))
    return p.select("p_partkey", latex.to_latex(runs).alias("l")).select("p_partkey", "l.latex", "l.confident")


@_query("SELECT p_partkey, p_name || ' 3/' || p_size || ' × x2n' AS said, p_size > 48 AS own_line FROM part")
def latex_text(spark, sf_dir):
    """LaTeX as readable text, and which of it needs a line of its own."""
    tex = F.concat(F.lit("\\("), "p_name", F.lit(" \\frac{3}{"), F.col("p_size").cast("string"), F.lit("} \\times x_{2}^{n}\\)"))
    long = F.when(F.col("p_size") > 48, F.lit("\\frac{a}{b}+\\frac{c}{d}")).otherwise("\\frac{a}{b}")
    return _t(spark, sf_dir, "part").select("p_partkey", latex.plain_text(tex).alias("said"), latex.needs_own_line(long).alias("own_line"))


@_query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '\\frac{' || p_size || '}{b}' WHEN 1 THEN '{x}_{1}^{2}' WHEN 2 THEN '\\sqrt{' || p_size || '\\times 2}' WHEN 3 THEN '\\left(a\\right)' WHEN 4 THEN '\\begin{aligned}a & b\\\\c\\end{aligned}' ELSE NULL END AS latex FROM part""")
def mathml_payloads(spark, sf_dir):
    """MathML within binary payloads, as LaTeX."""
    n = F.col("p_size").cast("string")
    body = F.element_at(F.array(
        F.concat(F.lit("<mfrac><mn>"), n, F.lit("</mn><mi>b</mi></mfrac>")), F.lit("<msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup>"), F.concat(F.lit("<msqrt><mn>"), n, F.lit("</mn><mo>×</mo><mn>2</mn></msqrt>")),
        F.lit("<mfenced><mi>a</mi></mfenced>"), F.lit("<mtable><mtr><mtd><mi>a</mi></mtd><mtd><mi>b</mi></mtd></mtr><mtr><mtd><mi>c</mi></mtd></mtr></mtable>"), F.lit("<mi>broken"),
    ), (F.col("p_partkey") % 6 + 1).cast("int"))
    payload = F.encode(F.concat(F.lit("\x02WMF"), F.lit("<math>"), body, F.lit("</math>tail")), "UTF-8")
    return _t(spark, sf_dir, "part").select("p_partkey", mathml.mathml_latex(payload).alias("latex"))


@_query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0.75::DOUBLE END AS r FROM part")
def matching_ratios(spark, sf_dir):
    """the share of two texts that matches."""
    return _t(spark, sf_dir, "part").select("p_partkey", similarity.matching_ratio(F.lit("abcd"), F.when(F.col("p_partkey") % 2 == 0, "abcd").otherwise("bcde")).alias("r"))
