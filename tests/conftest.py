"""One small session for all tests, and a synthetic package."""

from __future__ import annotations

import os
import sys
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYTHONPATH", str(ROOT))

DESIGNMAP = '<Document StoryList="ustory1 ustory2"><Spread src="Spreads/Spread_uspr.xml"/></Document>'


def story(story_id: str, *paragraphs: tuple[str, str]) -> str:
    """A story of (style, inner XML of a character range) paragraphs."""
    inner = "".join(f'<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/{s}">{x}</ParagraphStyleRange>' for s, x in paragraphs)
    return f'<x:Story xmlns:x="urn:x"><Story Self="{story_id}">{inner}</Story></x:Story>'


def csr(content: str, attrs: str = 'PointSize="11"') -> str:
    return f"<CharacterStyleRange {attrs}>{content}</CharacterStyleRange>"


def text(t: str) -> str:
    return f"<Content>{t}</Content>"


PARTS = {
    "designmap.xml": DESIGNMAP,
    "Stories/Story_ustory1.xml": story(
        "ustory1",
        ("Heading 1", csr(text("Solutions"), 'PointSize="24"')),
        ("Body", csr(text("Water boils at a ")) + csr(text("lower"), 'FontStyle="Bold" PointSize="11"') + csr(text(" temperature at altitude."))),
    ),
    "Stories/Story_ustory2.xml": story(
        "ustory2",
        ("Question", csr(text("What is molarity?"))),
        ("Option", csr(text("(A) moles per litre ") + '<Rectangle Self="a"><Image><Link LinkResourceURI="file:Links/eqn.wmf"/></Image></Rectangle>')),
    ),
    "Spreads/Spread_uspr.xml": '<x:Spread xmlns:x="urn:x"><Spread Self="uspr"><Page Self="p" Name="1" GeometricBounds="0 0 792 612" ItemTransform="1 0 0 1 0 0"/>'
    '<TextFrame Self="utf1" ParentStory="ustory1" GeometricBounds="50 50 300 300" ItemTransform="1 0 0 1 0 0"/><TextFrame Self="utf2" ParentStory="ustory2" GeometricBounds="350 50 600 300" ItemTransform="1 0 0 1 0 0"/></Spread></x:Spread>',
    "Resources/Styles.xml": '<x:Styles xmlns:x="urn:x"><ParagraphStyle Self="a" Name="Heading 1"/><ParagraphStyle Self="b" Name="Body"/></x:Styles>',
    "Resources/Fonts.xml": '<x:Fonts xmlns:x="urn:x"><FontFamily Self="f" Name="Minion Pro"/></x:Fonts>',
}


@pytest.fixture(scope="session")
def spark():
    from quire.shipping import ship

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)


@pytest.fixture
def package(tmp_path: Path) -> Path:
    folder = tmp_path / "pkg"
    (folder / "Links").mkdir(parents=True)
    (folder / "Document fonts").mkdir()
    with zipfile.ZipFile(folder / "sample.idml", "w") as z:
        for name, body in PARTS.items():
            z.writestr(name, body)
    return folder


@pytest.fixture
def parts(spark):
    rows = [("sample.idml", n, bytearray(b.encode())) for n, b in PARTS.items()]
    return spark.createDataFrame(rows, "doc_id string, part_name string, body binary")
