"""The command line: return codes, and what is written."""

from __future__ import annotations

import json
import shutil

import pytest

from quire import ConversionConfig, MobileProfile
from quire.__main__ import main, parser
from quire.operators import layout


def test_commands(spark, package, tmp_path, capsys):
    out = str(tmp_path / "out")
    assert main(["inspect", str(package), "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["stories"] == 2
    assert main(["convert", str(package), "--out", out, "--strategy", "threaded", "--min-font", "14"], spark) == 0
    assert "1 passed, 0 with errors, 0 not read" in capsys.readouterr().out
    assert "width:360px" in "".join(r.value for r in spark.read.text(f"{out}/css").collect())
    assert "required_files" in {r.check for r in spark.read.json(f"{out}/qa").collect()}
    assert main(["validate", out], spark) == 0
    assert main(["validate", out, "--min-font", "9"], spark) == 2
    shutil.rmtree(f"{out}/css")
    assert main(["validate", out], spark) == 2


def test_batch_goes_on_after_a_bad_package(spark, package, tmp_path, capsys):
    other = package.parent / "bad"
    other.mkdir()
    (other / "bad.idml").write_bytes(b"no package")
    assert main(["batch", str(package.parent), "--out", str(tmp_path / "out"), "--page-width", "400", "--fixed-height"], spark) == 1
    said = capsys.readouterr().out
    assert "1 passed, 0 with errors, 1 not read" in said and "bad.idml: 1" in said
    assert "width:400px" in "".join(r.value for r in spark.read.text(str(tmp_path / "out/css")).collect())
    assert main(["inspect", str(tmp_path / "out")], spark) == 1


def test_options():
    args = parser().parse_args(["convert", "a", "--out", "b"])
    assert args.paginated and args.strategy == "auto" and args.page_width == MobileProfile().page_width
    with pytest.raises(SystemExit):
        parser().parse_args(["convert", "a", "--out", "b", "--strategy", "none"])
    assert ConversionConfig().profile == MobileProfile()


def test_facsimile(spark):
    clip = "doc_id string, page int, clip_ix int, x0 double, x1 double"
    clips = spark.createDataFrame([("a", 0, 0, 0.0, 540.0), ("a", 1, 0, 0.0, 5.0), ("a", 1, 1, 0.0, 270.0), ("b", 0, 0, 0.0, 90.0)], clip)
    pages = spark.createDataFrame([("a", 0, 100.0), ("a", 1, 100.0), ("b", 0, 7.0)], "doc_id string, page int, height double")
    tiles = layout.facsimile_tiles(clips, pages)
    assert sorted((r.src, r.width_pt, r.height_pt) for r in tiles.collect()) == [("images/page_001_1.jpg", 270.0, 50.0), ("images/page_002_2.jpg", 270.0, 100.0)]
    html = {r.doc_id: r.html for r in layout.facsimile_pages(pages.select("doc_id").distinct(), tiles).collect()}
    assert html["a"].count("<img") == 2 and 'alt="page tile 2"' in html["a"] and "<body></body>" in html["b"]
