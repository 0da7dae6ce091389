"""Packages: discovery, parsing, conversion end to end."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from quire.plans import convert
from quire.sources import idml, packages


def test_discovery_and_unpacking(spark, package):
    files = packages.listing(spark, str(package.parent))
    found = packages.discover(files).collect()
    assert len(found) == 1 and found[0].idml_file.endswith("sample.idml")
    assert packages.nearest_packages(files).count() == 1
    parts = packages.unpack(spark, str(package))
    assert {r.part_name for r in parts.select("part_name").collect()} >= {"designmap.xml", "Stories/Story_ustory1.xml"}
    (package / "bad.idml").write_bytes(b"no zip")
    assert convert.failures(packages.unpack(spark, str(package))).count() == 1


def test_stories(parts):
    rows = idml.paragraphs(parts).orderBy("story_id", "para_ix").collect()
    assert [(r.story_id, r.para_style) for r in rows] == [("ustory1", "Heading 1"), ("ustory1", "Body"), ("ustory2", "Question"), ("ustory2", "Option")]
    body = rows[1].runs
    assert "".join(x.text for x in body) == "Water boils at a lower temperature at altitude." and [x.text for x in body if x.bold] == ["lower"]
    assert [x.image_uri for x in rows[3].runs if x.image_uri] == ["file:Links/eqn.wmf"]


def test_layout_and_resources(parts):
    pages, frames = idml.layout(parts)
    assert [(p.width, p.height, p.page_index) for p in pages.collect()] == [(612.0, 792.0, 0)]
    assert [(f.self_id, f.page_index, f.col, f.x, f.y) for f in frames.orderBy("frame_ix").collect()] == [("utf1", 0, 0, 50.0, 50.0), ("utf2", 0, 0, 50.0, 350.0)]
    assert {(r.kind, r.name) for r in idml.resources(parts).collect()} == {("font", "Minion Pro"), ("paragraph_style", "Heading 1"), ("paragraph_style", "Body")}


def test_table_grid():
    cell = lambda n, t, extra="": f'<Cell Name="{n}" {extra}><CharacterStyleRange><Content>{t}</Content></CharacterStyleRange></Cell>'
    table = ET.fromstring("<Table ColumnCount='3'>" + cell("0:0", "A", 'ColumnSpan="2"') + cell("2:0", "B", 'RowSpan="2"') + cell("0:1", "C") + cell("bad", "x") + "</Table>")
    rows = idml.table_grid(table)
    assert [[c["text"] for c in r] for r in rows] == [["A", "B"], ["C", ""]]
    assert rows[0][0]["colspan"] == 2 and rows[0][1]["rowspan"] == 2


def test_conversion(parts):
    c = convert.convert(parts)
    html = c.html.first().html
    assert "<title>Sample</title>" in html and '<h2 class="heading">Solutions</h2>' in html and "<strong>lower</strong>" in html and 'class="question"' not in html and 'class="qcont"' in html
    stats = c.stats.first()
    assert stats.tokens > 0 and stats.words > 0 and stats.pages == 1 and stats.equations == 1
    qa = {r.check: r for r in c.qa.collect()}
    assert qa["inline_equations_resolved"].ok is False and qa["horizontal_overflow"].skipped and qa["min_font_size"].ok
    assert c.coverage.first().equations == 1


def test_equations_resolve_inline_images(spark, parts):
    eq = spark.createDataFrame([("eqn.wmf", r"\frac{a}{b}", None)], "basename string, latex string, display boolean")
    html = convert.convert(parts, equations=eq).html.first().html
    assert r"\(\frac{a}{b}\)" in html


def test_inspect_and_guard(parts):
    r = convert.inspect(parts).first()
    assert (r.stories, r.spreads, r.pages, r.frames, r.threaded) == (2, 1, 1, 2, False)
    with pytest.raises(ValueError, match="source package"):
        convert.guard_output("/a/pkg", ["/a/pkg/x.idml"])


def test_outputs_are_guarded_apart_and_checked(spark, parts, tmp_path):
    from quire.sources import sinks
    from quire.streaming.events import Progress

    html = spark.createDataFrame([("/a/book.idml", "one"), ("/b/book.idml", "two"), ("/b/other.idml", "three")], "doc_id string, html string")
    names = {r.doc_id: r.document for r in sinks.output_folders(html).collect()}
    assert len(set(names.values())) == 3 and names["/b/other.idml"] == "other"
    with pytest.raises(ValueError, match="source package"):
        sinks.write_pages(html, "/a", ["/a/book.idml"])
    heard = []
    progress = Progress()
    progress.attach(lambda e: heard.append(e["stage"]))
    made = convert.convert(parts, progress=progress)
    rows = convert.write(made, str(tmp_path / "out"), progress=progress).collect()
    assert [(r.ok, r.detail) for r in rows] == [(True, '{"missing":[]}')]
    assert heard == ["parse", "cleanup", "group", "write"]
    assert "Solutions" in "".join(r.value for r in spark.read.text(str(tmp_path / "out/pages")).collect())


def test_link_check(spark, parts):
    links = spark.createDataFrame([("sample.idml", "eqn.wmf")], "doc_id string, name string")
    assert packages.check_links(parts, links).count() == 0  # stories are not looked at by default
    assert [r.present for r in packages.check_links(parts, links, "^Stories/").collect()] == [True]
    assert packages.check_links(parts, links.where(F.lit(False)), "^Stories/").first().present is False
