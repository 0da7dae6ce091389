"""Operators against plain list walks, and the expected results of the fixtures."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire import schema
from quire.functions import latex, mathml, text
from quire.operators import align, classify, cleanup, expand, grouping, order, qa, sections
from quire.sources import equations

FRAME = [c.split()[0] for c in schema.FRAMES.split(", ")]


def frames(spark, rows):
    """(doc, id, story, page, col, y, kind, prev, next) to frames."""
    out = [(d, i, f, k, s, c * 300.0, float(y), 10.0, 10.0, p, str(p), 1, a, b, "x.png" if k == "image" else "", c) for i, (d, f, s, p, c, y, k, a, b) in enumerate(rows)]
    return spark.createDataFrame(out, schema.FRAMES)


def placed(df):
    return [(r.kind, r.story_id) for r in df.orderBy("doc_id", "placement_ix").collect()]


def test_reading_order(spark):
    t = lambda d, f, s, c, y, a="", b="", k="text": (d, f, s, 0, c, y, k, a, b)
    assert placed(order.geometric(frames(spark, [t("a", "r", "right", 1, 10), t("a", "l", "left", 0, 10)]))) == [("story", "left"), ("story", "right")]
    assert placed(order.geometric(frames(spark, [t("a", "b", "b", 0, 200), t("a", "a", "a", 0, 20)]))) == [("story", "a"), ("story", "b")]
    threads = frames(spark, [t("a", "f1", "s", 0, 20, "", "f2"), t("a", "f2", "s", 1, 20, "f1")])
    assert placed(order.threaded(threads)) == placed(order.auto(threads)) == [("story", "s")]
    assert placed(order.geometric(frames(spark, [t("a", "t", "s", 0, 100), t("a", "i", "", 0, 10, k="image")]))) == [("image", ""), ("story", "s")]


def test_auto_is_threaded_or_geometric_by_document(spark):
    rng, rows = random.Random(1), []
    for d in "abcdefgh":
        for i in range(12):
            prev = f"f{i - 1}" if d in "abcd" and i and rng.random() < 0.5 else ""
            rows.append((d, f"f{i}", f"s{rng.randint(0, 4)}", rng.randint(0, 1), rng.randint(0, 1), rng.randint(0, 5), "image" if rng.random() < 0.2 else "text", prev, ""))
    df = frames(spark, rows)
    got = {d: placed(order.auto(df.where(F.col("doc_id") == d))) for d in "ae"}
    assert got["a"] == placed(order.threaded(df.where("doc_id = 'a'"))) and got["e"] == placed(order.geometric(df.where("doc_id = 'e'")))


BLOCK = "doc_id string, order_key int, block_kind string, type string, text string, story_id string, box_group int, box_kind string, anchored boolean, ex_label boolean"


def blocks(spark, docs):
    rows = [(d, i, k, t, x, s, 0, "", a, False) for d, items in docs.items() for i, (k, t, x, s, a) in enumerate(items)]
    return spark.createDataFrame(rows, BLOCK)


def lines(df, col="text"):
    out: dict = {}
    for r in df.orderBy("doc_id", "order_key").collect():
        out.setdefault(r.doc_id, []).append(r[col])
    return out


def test_merging_is_the_fold(spark):
    rng = random.Random(2)
    docs = {f"d{n}": [(rng.choice(["paragraph"] * 4 + ["heading"]), rng.choice(["", " ", "a", "b.", "c) ", "d ", "e:"]), rng.choice("ss t".replace(" ", ""))) for _ in range(rng.randint(1, 12))] for n in range(60)}
    want = {}
    for d, items in docs.items():
        out: list = []
        for kind, t, s in items:
            last = out[-1] if out else None
            if last and kind == "paragraph" == last[0] and last[2] == s and last[1].strip() and not last[1].rstrip().endswith(text.SENTENCE_ENDS):
                last[1] += (" " if last[3] and not last[3].endswith(" ") else "") + t
                last[3] = t
            else:
                out.append([kind, t, s, t])
        want[d] = [x[1] for x in out]
    rows = [(d, i, k, t, s) for d, items in docs.items() for i, (k, t, s) in enumerate(items)]
    df = spark.createDataFrame(rows, "doc_id string, order_key int, type string, text string, story_id string")
    g = cleanup.group_broken(df, ["doc_id"], ["order_key"], F.col("text"), F.col("type") == "paragraph", ["story_id"], "g")
    got: dict = {}
    prev = {}
    for r in g.orderBy("doc_id", "order_key").collect():
        parts = got.setdefault(r.doc_id, [])
        if prev.get(r.doc_id, (None,))[0] == r.g:
            before = prev[r.doc_id][1]
            parts[-1] += (" " if before and not before.endswith(" ") else "") + r.text
        else:
            parts.append(r.text)
        prev[r.doc_id] = (r.g, r.text)
    assert got == want


def test_anchored_runs_labels_first(spark):
    t = lambda x, a=True: ("text", "paragraph", x, "s", a)
    got = grouping.merge_anchored(blocks(spark, {"d": [t("p", False), t("body"), t("Key Note"), t("more"), t("q", False), t("tail")]}))
    rows = got.orderBy("order_key").collect()
    assert [(r.text, r.box_group, r.box_kind) for r in rows] == [("p", 0, ""), ("Key Note", 1, "callout"), ("body", 1, "callout"), ("more", 1, "callout"), ("q", 0, ""), ("tail", 2, "callout")]


def test_examples_and_question_headers(spark):
    t = lambda k, x: ("text", k, x, "s", False)
    ex = grouping.group_examples(blocks(spark, {"d": [t("question", "What?"), t("paragraph", "Ex-5"), t("solution", "Sol. Working")]}))
    assert lines(ex) == {"d": ["Ex-5", "What?", "Sol. Working"]}
    q = grouping.hoist_question_headers(blocks(spark, {"d": [t("question", "Q1"), t("question", "Q2"), t("paragraph", "Check Your Understanding"), t("question", "Q3")]}))
    rows = q.orderBy("order_key").collect()
    assert rows[0].text == "Check Your Understanding" and len({r.box_group for r in rows}) == 1 and {r.box_kind for r in rows} == {"questions"}


def test_layout_panels(spark):
    rng = random.Random(4)
    words = ["Years Paper", "Solutions", "3 sets", "x", "y", "z"]
    docs = {f"d{n}": [rng.choice(words) for _ in range(rng.randint(1, 30))] for n in range(80)}
    want = {}
    for d, items in docs.items():
        out, i = [x.lower() for x in items], 0
        while i < len(out):
            ends = [j + (out[j] != "solutions") for j in range(i + 1, min(len(out), i + 12)) if out[j] in ("solutions", "3 sets")] if out[i] == "years paper" else []
            if ends:
                del out[i : ends[0]]
            else:
                i += 1
        want[d] = out
    got = lines(cleanup.drop_layout_panels(blocks(spark, {d: [("text", "paragraph", x, "s", False) for x in items] for d, items in docs.items()})).withColumn("text", F.lower("text")))
    assert {d: x for d, x in want.items() if x} == got


def test_box_tiers():
    assert expand.box_tier("51%", False) == "drop" and expand.box_tier("51%", True) == "inline" and expand.box_tier("Key Note", False) == "inline"
    assert expand.box_tier("a rather long definition with many words in it", False) == "box" and expand.box_tier("moles per litre", False) == "inline"


def test_recursion_expands_a_box_once(spark):
    p = lambda s, i, t="", box="": ("d", s, "part", i, "", [{"text": t, "bold": False, "italic": False, "superscript": False, "subscript": False, "char_style": "", "font": "", "point_size": 0.0, "image_uri": "", "textframe_story": box, "grid": None}])
    long = "this callout says enough words to be a box of its own"
    rows = [p("a", 0, "start"), p("a", 1, "", "b"), p("a", 2, "", "b"), p("b", 0, long), p("b", 1, "", "a"), p("b", 2, "", "b"), p("a", 3, "end")]
    paras = spark.createDataFrame(rows, schema.PARAGRAPHS)
    place = spark.createDataFrame([("d", 0, "story", 0, 0, 0.0, 0.0, "a", 0, "f", 1.0, 1.0, "")], schema.PLACEMENTS)
    got = expand.reconstruct(place, paras).orderBy("order_key").collect()
    assert [r.text for r in got] == ["start", long, "start", "end", "end"] or [r.text for r in got].count(long) == 1
    assert got[0].anchored is False and any(r.anchored for r in got)


def test_titles_and_sections(spark):
    b = blocks(spark, {"01_Solution": [("text", "paragraph", "lead", "s", False), ("text", "heading", "SOLUTIONS", "s", False), ("text", "paragraph", "hello world.", "s", False)], "02_other": [("text", "paragraph", "x", "s", False)]})
    titles = sections.guess_titles(b, spark.createDataFrame([("01_Solution", "01_Solution"), ("02_other", "02_other-of x")], "doc_id string, stem string"))
    assert {r.doc_id: r.title for r in titles.collect()} == {"01_Solution": "SOLUTIONS", "02_other": "Other-Of X"}
    secs = sections.sections(sections.section_blocks(b)).orderBy("doc_id", "section_ix").collect()
    assert [(s.section_ix, s.title, s.level, s.children) for s in secs] == [(0, "", 1, 1), (1, "SOLUTIONS", 2, 2), (0, "", 1, 1)]


def one(spark, c):
    return spark.range(1).select(c.alias("c")).first().c


def test_classification(spark):
    styles = {"Chapter Name": "chapter_title", "Heading 2": "subheading", "NEW:Head-13": "heading", "Key Bullet": "list_item", "Indent": "subpoint", "Figure": "caption", "Example": "example", "Que text": "question", "Option": "option", "Answer key": "solution", "Note": "note", "Body": None}
    df = spark.createDataFrame([(s,) for s in styles], "s string")
    assert {r.s: r.t for r in df.select("s", classify.style_type(F.col("s")).alias("t")).collect()} == styles
    shapes = {"1. x": "option", "Q1 x": "question", "(A) y": "option", "12. y": "question", "plain": "paragraph"}
    df = spark.createDataFrame([(s,) for s in shapes], "s string")
    assert {r.s: r.t for r in df.select("s", classify.shape_type(F.col("s")).alias("t")).collect()} == shapes


def test_scalar_functions(spark):
    lit = F.lit
    assert one(spark, text.link_key(lit("file:///C:/x/Eqn%2DJEE_M+4.WMF"))) == "eqn-jee_m+4.wmf"
    assert one(spark, text.symbol_text(lit("\uf06c\uf083\uf051"), lit("MT Extra"))) == "l\u21ccC"
    assert one(spark, text.strip(lit("\u00a0 a b\t\n"))) == "a b" and one(spark, text.safe_stem(lit("a/b c!.x.png"))) == "b_c_.x"
    assert one(spark, text.percent(lit(1), lit(0))) == 100.0 and one(spark, text.duration(lit(125.0))) == "2m 05s"
    assert mathml.embedded_latex(b"pre<math><mfrac><mi>x</mi><mn>2</mn></mfrac></math>post") == r"\frac{x}{2}"
    assert mathml.embedded_latex(b"<math><mover><mi>x</mi><mo>-</mo></mover><munder><mo>lim</mo><mi>n</mi></munder></math>") == r"\bar{x}\underset{n}{lim}"
    assert mathml.embedded_latex(b"none") is None and mathml.embedded_latex(b"<math><a></math>") is None
    assert one(spark, latex.plain_text(lit(r"\frac{a}{b} \times x_{2}"))) == "a/b × x2"
    assert one(spark, text.tidy_story_text(lit("a\u2028b\t\tc"))) == "a\nb c"


def test_equation_map(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"equations": {" A.WMF ": "x", "b": {"latex": "y", "display": true}, "c": {"latex": " "}, "d": 3}}')
    rows = {r.basename: (r.latex, r.display) for r in equations.load(spark, str(tmp_path / "e.json")).collect()}
    assert rows["a.wmf"] == ("x", None) and rows["b"] == ("y", True) and "c" not in rows


def test_qa_fails_on_errors_only(spark):
    rows = [("a", "x", True, True, False, None), ("a", "y", False, False, False, None), ("b", "x", False, True, False, None)]
    got = {r.doc_id: (r.passed, r.warnings, r.errors) for r in qa.verdicts(spark.createDataFrame(rows, "doc_id string, `check` string, ok boolean, is_error boolean, skipped boolean, detail string")).collect()}
    assert got == {"a": (True, ["y"], []), "b": (False, [], ["x"])}


def test_visual_insertion():
    line = [{"order_key": i, "block_kind": "text", "page": p, "y": y, "src": "", "blanks": 0, "visual_ix": None} for i, (p, y) in enumerate([(0, 10.0), (1, 5.0), (1, 50.0)])]
    pic = {"kind": "figure", "page": 1, "y0": 30.0, "before_key": None, "after_key": None, "before_score": None, "after_score": None, "long_before": False}
    new = {"order_key": None, "block_kind": "image", "page": 1, "y": 30.0, "src": "p", "blanks": 0}
    assert [r["order_key"] for r in align.insert_visual(line, pic, new)] == [0, 1, None, 2]
    assert align.insert_visual(line, pic | {"kind": "opener"}, new)[0] is new and align.insert_visual(line, pic | {"kind": "finisher"}, new)[-1] is new
    assert [r["order_key"] for r in align.insert_visual(line, pic | {"before_key": 0, "before_score": 0.9}, new)] == [0, None, 1, 2]


@pytest.mark.parametrize("spread", [True, False])
def test_alignment(spark, spread):
    b = spark.createDataFrame([("d", i, "text", t, 0, 0.0) for i, t in enumerate(["water boils at a lower temperature", "never printed anywhere zz", "salt melts ice on the road"])], "doc_id string, order_key int, block_kind string, text string, page int, y double")
    pdf = spark.createDataFrame([("d", 0, 0, 0.0, 10.0, 1.0, 20.0, "Water boils at a LOWER temperature!"), ("d", 2, 0, 0.0, 30.0, 1.0, 40.0, "salt melts ice on the road")], schema.PDF_BLOCKS)
    got = [(r.page, r.y) for r in align.align_positions(b, pdf, spread_unmatched=spread).orderBy("order_key").collect()]
    assert got[0] == (0, 10.0) and got[2] == (2, 30.0)


def test_alignment_scores_as_a_plain_search_does():
    """F1: the best candidate is that of all scores taken one by one, though few ratios are computed."""
    import random

    from quire.functions.similarity import ratio

    rng = random.Random(7)
    words = "water boils at lower heat salt melts ice on the road north of town".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def plain(needle, norms, threshold):
        best, at, probe = 0.0, -1, needle[:120]
        for i, c in enumerate(norms):
            s = 1.0 if probe[: align.PREFIX] in c else 0.92 if c[: align.PREFIX] in needle else ratio(probe, c[: max(120, len(probe))])
            if s > best:
                best, at = s, i
        return (best, at) if best >= threshold and at >= 0 else (0.0, -1)

    for _ in range(300):
        norms = [text(rng.randint(2, 30)) for _ in range(rng.randint(0, 12))]
        needle = text(rng.randint(2, 30))
        if norms and rng.random() < 0.5:
            needle = norms[-1][: rng.randint(8, 60)] + rng.choice(["", " zz", " heat"])
        for threshold in (0.0, 0.55, 0.8):
            assert align._best_candidate(needle, norms, 0, len(norms), threshold) == plain(needle, norms, threshold)


def test_alignment_computes_no_ratio_for_lines_found_whole(monkeypatch):
    """the eight candidates before the cursor were compared in full for each line."""
    calls = []
    monkeypatch.setattr(align, "ratio", lambda a, b: calls.append(1) or 0.0)
    norms = [f"line number {i} of the text that is printed" for i in range(100)]
    assert [align._best_candidate(n, norms, max(0, i - 8), 100, 0.55) for i, n in enumerate(norms)] == [(1.0, i) for i in range(100)] and not calls


def test_alignment_tables_and_kept_pages(spark):
    """blocks and candidates meet once, without pandas; tables follow their text, a page that is known stays."""
    rows = [("d", 0, "table", "", 0, 1.0), ("d", 1, "text", "water boils at a lower temperature", 0, 0.0), ("d", 2, "table", "", 0, 5.0), ("d", 3, "text", "zzzz qqqq", 4, 7.0), ("d", 4, "image", None, 9, 9.0), (None, 0, "text", "salt melts ice on the road", 0, 0.0), ("e", 0, "text", None, 0, 0.0)]
    b = spark.createDataFrame(rows, "doc_id string, order_key int, block_kind string, text string, page int, y double")
    pdf = spark.createDataFrame([("d", 2, 0, 0.0, 10.0, 1.0, 20.0, "Water boils at a LOWER temperature!"), ("d", 3, 0, 0.0, 30.0, 1.0, 40.0, "short"), ("f", 3, 0, 0.0, 30.0, 1.0, 40.0, "a document of no block")], schema.PDF_BLOCKS)
    out = align.align_positions(b, pdf)
    assert "InPandas" not in out._jdf.queryExecution().toString() and out.columns == b.columns
    got = {(r.doc_id, r.order_key): (r.page, r.y, r.text) for r in out.collect()}
    assert len(got) == len(rows)
    assert [got["d", i][:2] for i in range(5)] == [(0, 1.0), (2, 10.0), (2, 10.1), (4, 7.0), (9, 9.0)] and got["e", 0] == (0, 0.0, None) and got["d", 4][2] is None


def test_anchors_score_as_a_plain_search_does():
    """the text most like an anchor is that of all scores taken one by one."""
    import random

    from quire.functions.similarity import ratio

    rng = random.Random(3)
    words = "water boils at lower heat salt melts ice on the road north of town".split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))

    def plain(target, texts, before):
        target, found = target[-1200:] if before else target[:1200], []
        for key, c in texts if len(target) >= 12 else ():
            if len(c) >= align.LEAST:
                near = target[-220:] if before else target[:220]
                s = 1.0 + min(len(c), 200) / 1000.0 if c[: align.PREFIX] in target else 0.95 if target[: align.PREFIX] in c else ratio(c[:180], near)
                found.append((s, -key))
        s, key = max(found, default=(0.0, 0))
        return (-key, s) if s >= 0.42 else None

    for _ in range(300):
        texts = [(k, text(rng.randint(1, 40))) for k in rng.sample(range(50), rng.randint(0, 10))]
        target = texts[-1][1][: rng.randint(5, 80)] + " zz" if texts and rng.random() < 0.4 else text(rng.randint(1, 60))
        assert all(align.anchor_score(target, texts, b) == plain(target, texts, b) for b in (True, False))


def test_recovered_visuals_meet_blocks_once(spark):
    """one exchange and no pandas; documents of pictures alone, unknown pages and unknown ids keep their rows."""
    from pyspark.sql import functions as F

    rows = [("d", 0, "text", "water boils at a lower temperature", 0, 0.0, ""), ("d", 1, "text", "salt melts ice on the road", None, None, ""), ("d", 2, "text", "Chapter complete", 1, 0.0, ""), (None, 0, "text", "chapter complete", 0, 0.0, ""), ("e", 0, "text", "chapter complete", 0, 0.0, "")]
    b = spark.createDataFrame(rows, "doc_id string, order_key int, block_kind string, text string, page int, y double, src string")
    b = b.withColumns({"alt": F.lit(""), "original_ref": F.lit(""), "grid": F.lit(None).cast(schema.GRID)})
    pics = [("d", 0, 0, 50.0, "f.png", 1.0, 1.0, "figure", "Water boils at a lower temperature.", ""), ("d", 1, 0, 60.0, "g.png", 1.0, 1.0, "figure", "", ""), ("d", 2, 1, 0.0, "z.png", 1.0, 1.0, "finisher", None, None), ("v", 0, 0, None, "o.png", 1.0, 1.0, "opener", "", ""), ("v", 1, None, 1.0, "p.png", 1.0, 1.0, "figure", "", "")]
    out = align.recover_visuals(b, spark.createDataFrame(pics, schema.VISUALS))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and plan.count("Exchange") == 1 and out.columns == b.columns
    got = {}
    for r in out.orderBy("doc_id", "order_key").collect():
        got.setdefault(r.doc_id, []).append(r.src or r.text)
    assert got == {None: ["chapter complete"], "d": ["water boils at a lower temperature", "f.png", "g.png", "salt melts ice on the road", "z.png"], "e": ["chapter complete"], "v": ["o.png", "p.png"]}


def test_strip_cuts_all_white_space(spark):
    """ends are looked at without a scan; the same characters go as before."""
    from pyspark.sql import functions as F

    from quire.functions.text import rstrip, strip

    spaces = "".join(c for c in map(chr, range(0x10000)) if c.isspace())
    rows = [(s,) for s in (f"{spaces}a{spaces}b{spaces}", "", spaces, " ᠎ x​ ", "\U0001f600 \n", None)]
    got = spark.createDataFrame(rows, "t string").select(strip(F.col("t")), rstrip(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(None, None) if t is None else (t.strip(), t.rstrip()) for (t,) in rows]


def test_clean_spaces(spark):
    from pyspark.sql import functions as F

    rows = [(t,) for t in ("a b", "a  b", "\ta \t b\t", "a  b  ", " ", "", "  \n  ")]
    got = [r.c for r in spark.createDataFrame(rows, "t string").select(cleanup.clean_spaces(F.col("t")).alias("c")).collect()]
    assert got == ["a b", "a b", " a b ", "a b ", " ", "", " \n "]


def test_expansion_and_grouping_without_pandas(spark):
    """folds stream through Arrow batches of many documents; a fold sees whole documents, however batches are cut."""
    from quire.operators.folds import fold

    t = lambda k, x: ("text", k, x, "s", False)
    items = [t("question", "What?"), t("paragraph", "Ex-5"), t("solution", "Sol. Working"), t("heading", "Next"), t("question", "Q1"), t("paragraph", "Check Your Understanding"), t("question", "Q3")]
    b = blocks(spark, {f"d{i}": items for i in range(40)})
    both, one = grouping.hoist_question_headers(grouping.group_examples(b)), grouping.group_questions(b)
    assert "InPandas" not in both._jdf.queryExecution().toString() and sorted(both.collect()) == sorted(one.collect())
    assert set(map(tuple, lines(one).values())) == {("Ex-5", "What?", "Sol. Working", "Next", "Check Your Understanding", "Q1", "Q3")}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(None if d == 3 else f"d{d:02}", i, "x" * i) for d in range(20) for i in range(d)]
        df = spark.createDataFrame(rows, "doc_id string, i int, said string")
        got = fold(df, ["i"], lambda own: [(len(own), r[0] is None, own[-1][1] - r[1] if r[0] else None) for r in own], "n int, none boolean", ["i"], ["said"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(d, d == 3, None if d == 3 else "x" * (d - 1 - i)) for d in range(20) for i in range(d)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
