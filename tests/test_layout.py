"""Page layout from tables of words, blocks and raster rows."""

from __future__ import annotations

from quire.operators import layout


def test_columns_need_text_on_both_sides(spark):
    pages = spark.createDataFrame([("d", p, 400.0, 600.0) for p in range(4)], "doc_id string, page int, width double, height double")
    sides = [(20.0, 168.0), (232.0, 380.0)]
    words, blocks = [], []
    for page in (0, 1):
        words += [("d", page, *sides[i % 2]) for i in range(50)]
        blocks += [("d", page, *sides[i % 2]) for i in range(8)]
    words += [("d", 2, 20.0, 380.0)] * 50 + [("d", 3, *sides[0])] * 50
    blocks += [("d", 2, 20.0, 380.0)] * 8 + [("d", 3, *sides[0])] * 8
    span = "doc_id string, page int, x0 double, x1 double"
    gutter = layout.gutters(spark.createDataFrame(words, span), pages, spark.createDataFrame(blocks, span))
    assert {(r.page, r.gutter) for r in gutter.collect()} == {(0, 200.0), (1, 200.0)}
    clips = sorted((r.page, r.clip_ix, r.x0, r.x1) for r in layout.column_clips(pages, gutter).collect())
    # the first page stays whole
    assert clips == [(0, 0, 0.0, 400.0), (1, 0, 0.0, 210.0), (1, 1, 190.0, 400.0), (2, 0, 0.0, 400.0), (3, 0, 0.0, 400.0)]


def test_figure_bands(spark):
    row = lambda page, y, density=0.1, colour=0.1, fig=True: ("d", page, 0, float(y), fig, density, colour)
    rows = [row(1, y) for y in (0, 10, 25, 40)] + [row(1, 80), row(1, 85)]  # a band, and one too low
    rows += [row(1, y, density=0.9) for y in (200, 215, 230)] + [row(1, y, colour=0.5) for y in (300, 315, 330)]  # dense; coloured
    rows += [row(2, y) for y in (0, 15, 30)] + [row(0, y) for y in (0, 15, 30)] + [row(1, y, fig=False) for y in (45, 50, 55)]
    df = spark.createDataFrame(rows, "doc_id string, page int, col int, y double, is_figure boolean, density double, colour double")
    bands = layout.figure_bands(df)
    assert {(r.page, r.y0, r.y1) for r in bands.collect()} == {(1, 0.0, 40.0), (2, 0.0, 30.0), (0, 0.0, 30.0)}
    ends = spark.createDataFrame([("d", 2)], "doc_id string, page int")
    assert [(r.page, r.visual_ix) for r in layout.figure_pages(layout.top_bands(bands), ends).collect()] == [(1, 0)]
    many = spark.createDataFrame([("d", 1, 0, i, float(50 * i), float(50 * i + 30)) for i in range(30)], "doc_id string, page int, col int, band_ix int, y0 double, y1 double")
    assert layout.top_bands(many).count() == layout.FIGURES_PER_PAGE


def test_openers_finishers_and_anchors(spark):
    pages = spark.createDataFrame([(d, p, 400.0, 600.0) for d in "ab" for p in (0, 1)], "doc_id string, page int, width double, height double")
    t = [("a", 0, 10.0, 90.0, 300.0, 110.0, "x" * 121), ("a", 1, 10.0, 50.0, 300.0, 60.0, "Chapter Complete"), ("a", 1, 10.0, 70.0, 300.0, 80.0, "after"), ("a", 1, 350.0, 58.0, 390.0, 59.0, "beside"), ("b", 0, 10.0, 5.0, 300.0, 9.0, "short")]
    pdf = spark.createDataFrame(t, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, text string")
    assert {(r.doc_id, r.y0, r.y1) for r in layout.opener(pdf, pages).collect()} == {("a", 0.0, 90.0), ("b", 0.0, 300.0)}
    assert [(r.doc_id, r.page, r.y0, r.y1) for r in layout.finishers(pdf, pages, "chapter COMPLETE").collect()] == [("a", 1, 42.0, 600.0)]
    v = spark.createDataFrame([("a", 1, 20.0, 62.0, 200.0, 68.0)], "doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.anchor_before, r.anchor_after) for r in layout.visual_anchors(v, pdf).collect()] == [("Chapter Complete", "after")]
