"""Registered queries over the driver's tables, and the same in SQL.

Where the subject is not documents (conversations as frames, events as blocks) the query is an analogy: the same
operator, other rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import html as H
from quire.functions.geometry import bounding_box
from quire.functions.text import file_name, link_key, match_norm, percent, safe_stem, strip, token_estimate, words_count
from quire.operators import align, classify, cleanup, lookup, order, qa, sections, sequence
from quire.sources import html as pages_source
from quire.sources import idml, text

QUERIES: dict = {}
SQL: dict[str, str] = {}
_NL = "chr(10)"
#: Lines of documents, as SQL.
_LINES = f"(SELECT doc_id, i - 1 AS para_ix, a[i] AS text FROM (SELECT doc_id, string_split(text, {_NL}) AS a FROM documents), unnest(generate_series(1, len(a))) AS t(i))"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _long(*names: str) -> dict:
    return {n: F.col(n).cast("long") for n in names}


# -- documents ---------------------------------------------------------------------------------------------------------


@_query(f"""SELECT doc_id, sum(length(text))::BIGINT AS characters,
  sum(CASE WHEN trim(text) = '' THEN 0 ELSE len(regexp_split_to_array(trim(text), '\\s+')) END)::BIGINT AS words,
  count(*)::BIGINT AS text_blocks, ceil(sum(length(text)) / 4.0)::BIGINT AS tokens FROM {_LINES} GROUP BY doc_id""")
def doc_stats(spark, sf_dir):
    """A3: volume of each document, over its lines."""
    rows = text.lines(_t(spark, sf_dir, "documents"))
    out = rows.groupBy("doc_id").agg(F.sum(F.length("text")).alias("characters"), F.sum(words_count(F.col("text"))).alias("words"), F.count("*").alias("text_blocks"))
    return out.withColumn("tokens", token_estimate(F.col("characters")))


@_query(f"SELECT doc_id, para_ix::BIGINT AS para_ix, text FROM {_LINES}")
def doc_paragraphs(spark, sf_dir):
    """Paragraphs, with their place."""
    return text.lines(_t(spark, sf_dir, "documents")).withColumns(_long("para_ix"))


@_query(f"""SELECT doc_id, para_ix::BIGINT AS para_ix, CASE WHEN regexp_matches(t, '^\\s*\\(?[A-Da-d1-4][\\).]\\s+') AND length(t) < 200 THEN 'option'
  WHEN regexp_matches(t, '^\\s*(Q\\.?\\s*\\d+|Question\\s*\\d+|\\d+\\.)\\s', 'i') THEN 'question' ELSE 'paragraph' END AS type FROM (SELECT *, trim(text) AS t FROM {_LINES})""")
def para_classify(spark, sf_dir):
    """The shape of each line."""
    rows = text.lines(_t(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("para_ix").cast("long").alias("para_ix"), classify.shape_type(F.col("text")).alias("type"))


@_query("""SELECT p_partkey, CASE WHEN regexp_matches(p_name, 'chapter\\s*name', 'i') THEN 'chapter_title' WHEN regexp_matches(p_type, 'bullet', 'i') THEN 'list_item'
  WHEN regexp_matches(p_type, 'note|callout|tip|caution|important', 'i') THEN 'note' ELSE 'none' END AS type FROM part""")
def style_classify(spark, sf_dir):
    """P3 (analogy): style rules over the types of parts."""
    kind = classify.style_type(F.col("p_type"))
    return _t(spark, sf_dir, "part").select("p_partkey", F.coalesce(kind, F.lit("none")).alias("type"))


@_query(f"SELECT doc_id, para_ix::BIGINT AS para_ix, regexp_replace(replace(replace(text, chr(8232), ' '), chr(8233), ' '), '[ \\t]+', ' ', 'g') AS text FROM {_LINES}")
def whitespace_normalize(spark, sf_dir):
    """Clean spaces."""
    return text.lines(_t(spark, sf_dir, "documents")).select("doc_id", F.col("para_ix").cast("long").alias("para_ix"), cleanup.clean_spaces(F.col("text")).alias("text"))


@_query(f"SELECT doc_id, count(*)::BIGINT AS kept FROM {_LINES} WHERE trim(text) <> '' GROUP BY doc_id")
def drop_empty(spark, sf_dir):
    """P10: lines that say something."""
    return text.lines(_t(spark, sf_dir, "documents")).where(strip(F.col("text")) != "").groupBy("doc_id").agg(F.count("*").alias("kept"))


@_query(f"""WITH l AS {_LINES}, t AS (SELECT *, last_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS tail,
  lag(text) OVER (PARTITION BY doc_id ORDER BY para_ix) AS prev FROM l),
s AS (SELECT *, CASE WHEN tail IS NULL OR right(rtrim(tail), 1) IN ('.', '!', '?', ':', ';', chr(8221), '"', ')') THEN 1 ELSE 0 END AS start FROM t),
g AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY para_ix) AS grp FROM s)
SELECT doc_id, grp::BIGINT AS block_ix, string_agg(CASE WHEN start = 0 AND prev <> '' AND right(prev, 1) <> ' ' THEN ' ' || text ELSE text END, '' ORDER BY para_ix) AS text FROM g GROUP BY doc_id, grp""")
def merge_broken(spark, sf_dir):
    """Lines that go on from the line before, joined."""
    rows = text.lines(_t(spark, sf_dir, "documents"))
    g = cleanup.group_broken(rows, ["doc_id"], ["para_ix"], F.col("text"), F.lit(True), [], "block_ix")
    w = sequence.window(["doc_id"], ["para_ix"])
    goes_on = F.coalesce(F.lag("block_ix").over(w) == F.col("block_ix"), F.lit(False))
    prev = F.lag("text").over(w)
    piece = F.when(goes_on & cleanup.needs_space(prev), F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    out = g.withColumn("piece", piece).groupBy("doc_id", "block_ix").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_ix", "piece"))), lambda x: x["piece"]), "").alias("text"))
    return out


@_query(f"SELECT doc_id, para_ix::BIGINT AS para_ix, text FROM (SELECT *, lag(trim(text)) OVER (PARTITION BY doc_id ORDER BY para_ix) AS p FROM {_LINES}) WHERE p IS NULL OR p <> trim(text)")
def collapse_repeats(spark, sf_dir):
    """Lines that do not repeat the line before."""
    rows = text.lines(_t(spark, sf_dir, "documents"))
    return sequence.collapse_repeats(rows, ["doc_id"], ["para_ix"], strip(F.col("text"))).withColumns(_long("para_ix"))


@_query("""SELECT doc_id, trim(regexp_replace(lower(replace(text, chr(173), '')), '[^a-z0-9%]+', ' ', 'g')) AS norm FROM documents""")
def match_form(spark, sf_dir):
    """the form in which texts of two sources are compared."""
    return _t(spark, sf_dir, "documents").select("doc_id", match_norm(F.col("text")).alias("norm"))


@_query(f"""WITH l AS (SELECT *, trim(text) AS t FROM {_LINES}), h AS (SELECT *, CASE WHEN length(t) > 0 AND length(t) < 30 THEN 1 ELSE 0 END AS is_head FROM l),
s AS (SELECT *, sum(is_head) OVER (PARTITION BY doc_id ORDER BY para_ix) AS section_ix FROM h)
SELECT doc_id, section_ix::BIGINT AS section_ix, coalesce(arg_min(CASE WHEN is_head = 1 THEN t ELSE '' END, para_ix), '') AS title, (CASE WHEN section_ix > 0 THEN 2 ELSE 1 END)::BIGINT AS level, count(*)::BIGINT AS children
FROM s GROUP BY doc_id, section_ix""")
def doc_sections(spark, sf_dir):
    """Short lines taken for headings open sections."""
    rows = text.lines(_t(spark, sf_dir, "documents")).withColumn("t", strip(F.col("text")))
    blocks = rows.select("doc_id", F.col("para_ix").alias("order_key"), F.lit("text").alias("block_kind"), "text", F.when((F.length("t") > 0) & (F.length("t") < 30), "heading").otherwise("paragraph").alias("type"))
    return sections.sections(sections.section_blocks(blocks)).withColumns(_long("section_ix", "level"))


@_query("""SELECT d.source, count(*)::BIGINT AS docs, count(l.doc_id)::BIGINT AS labelled, CASE WHEN count(*) = 0 THEN 100.0 ELSE round_even(100.0 * count(l.doc_id) / count(*), 1) END AS labelled_pct
  FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY d.source""")
def label_coverage(spark, sf_dir):
    """A1, A2: share of each source's documents that are labelled."""
    d, ids = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("hit")).distinct()
    out = d.select("doc_id", "source").join(ids, "doc_id", "left").groupBy("source").agg(F.count("*").alias("docs"), F.count("hit").alias("labelled"))
    return out.withColumn("labelled_pct", percent(F.col("labelled"), F.col("docs")))


@_query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS present FROM (SELECT DISTINCT doc_id FROM documents)""")
def missing_links(spark, sf_dir):
    """Ids with a label, and those without."""
    have, lack = lookup.present_and_missing(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"), ["doc_id"])
    return have.withColumn("present", F.lit(True)).unionByName(lack.withColumn("present", F.lit(False)))


@_query("""SELECT d.doc_id, coalesce('quality:' || l.quality, 'item:' || b.item_id, 'text') AS resolved FROM documents d
  LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id LEFT JOIN benchmark b ON d.doc_id = b.item_id""")
def resolve_ladder(spark, sf_dir):
    """J7, J8 (analogy): the first lookup that knows the key; only what is left goes on to the next."""
    d = _t(spark, sf_dir, "documents").select("doc_id")
    first = _t(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = d.join(first, "doc_id", "left")
    rest = known.where("quality is null").join(_t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("hit")), "doc_id", "left")
    out = known.where("quality is not null").select("doc_id", F.concat(F.lit("quality:"), F.col("quality").cast("string")).alias("resolved"))
    return out.unionByName(rest.select("doc_id", F.when(F.col("hit"), F.concat(F.lit("item:"), F.col("doc_id").cast("string"))).otherwise("text").alias("resolved")))


_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9%]+', ' ', 'g'))"


def _passages(spark, sf_dir) -> DataFrame:
    """(doc_id, item_id, whole): documents that hold the beginning of an item."""
    d = _t(spark, sf_dir, "documents").select("doc_id", match_norm(F.col("text")).alias("norm"))
    return align.contained_passages(d, _t(spark, sf_dir, "benchmark").select("item_id", match_norm(F.col("text")).alias("item")))


@_query(f"""WITH d AS (SELECT doc_id, {_NORM.format('text')} AS norm FROM documents), b AS (SELECT item_id, {_NORM.format('text')} AS item FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(norm, left(item, 35)) WHERE length(item) >= 35""")
def passage_match(spark, sf_dir):
    """Documents that hold the beginning of an item: items are the query set, texts are scanned once."""
    return _passages(spark, sf_dir).select("doc_id", "item_id")


@_query(f"""WITH d AS (SELECT doc_id, {_NORM.format('text')} AS norm FROM documents), b AS (SELECT item_id, {_NORM.format('text')} AS item FROM benchmark),
j AS (SELECT item_id, doc_id, CASE WHEN contains(norm, item) THEN 1.0::DOUBLE ELSE 0.92::DOUBLE END AS score FROM d JOIN b ON contains(norm, left(item, 35)) WHERE length(item) >= 35)
SELECT item_id, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM j) WHERE r = 1""")
def passage_best(spark, sf_dir):
    """Each item's best document; of equal scores the first."""
    scored = _passages(spark, sf_dir).withColumn("score", F.when(F.col("whole"), 1.0).otherwise(0.92))
    best = scored.groupBy("item_id").agg(F.max_by(F.struct("doc_id", "score"), F.struct("score", -F.col("doc_id"))).alias("b"))
    return best.select("item_id", "b.doc_id", "b.score")


@_query("""SELECT source, doc_id, n::BIGINT AS words FROM (SELECT source, doc_id, len(string_split(text, ' ')) AS n, row_number() OVER (PARTITION BY source ORDER BY len(string_split(text, ' ')) DESC, doc_id) AS r FROM documents) WHERE r <= 20""")
def token_topk(spark, sf_dir):
    """L2: the twenty longest documents of each source."""
    d = _t(spark, sf_dir, "documents").select("source", "doc_id", F.size(F.split("text", " ")).cast("long").alias("words"))
    return d.withColumn("r", F.row_number().over(W.partitionBy("source").orderBy(F.desc("words"), "doc_id"))).where("r <= 20").drop("r")


# -- packages made of documents ----------------------------------------------------------------------------------------


def package_parts(docs: DataFrame) -> DataFrame:
    """Package parts whose one story holds a document's lines, made by column functions."""
    esc = lambda c: H.esc(c, quote=False)
    lines = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", ""), "\n", -1)
    para = lambda t: F.concat(F.lit('<ParagraphStyleRange AppliedParagraphStyle="ParagraphStyle/Body"><CharacterStyleRange PointSize="11"><Content>'), esc(t), F.lit("</Content></CharacterStyleRange></ParagraphStyleRange>"))
    sid = F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    story = F.concat(F.lit('<Story_><Story Self="'), sid, F.lit('">'), F.array_join(F.transform(lines, para), ""), F.lit("</Story></Story_>"))
    spread = F.concat(F.lit('<Spread_><Spread Self="s"><Page Self="p" Name="1" GeometricBounds="0 0 792 612" ItemTransform="1 0 0 1 0 0"/><TextFrame Self="t" ParentStory="'), sid, F.lit('" GeometricBounds="50 50 300 300" ItemTransform="1 0 0 1 0 0"/></Spread></Spread_>'))
    designmap = F.concat(F.lit('<Document StoryList="'), sid, F.lit('"><Spread src="Spreads/Spread_s.xml"/></Document>'))
    # names first: a part's body is made only where that part is read
    bodies = {"designmap.xml": designmap, "Stories/Story_a.xml": story, "Spreads/Spread_s.xml": spread}
    rows = docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, bodies))).alias("part_name"))
    body = F.coalesce(*(F.when(F.col("part_name") == n, F.encode(b, "UTF-8")) for n, b in bodies.items()))
    return rows.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".idml")).alias("doc_id"), "part_name", body.alias("body"))


@_query(f"""SELECT 'doc' || doc_id || '.idml' AS doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY para_ix) - 1)::BIGINT AS para_ix, text FROM {_LINES} WHERE text <> ''""")
def package_paragraphs(spark, sf_dir):
    """Stories of packages made of the documents, parsed back."""
    p = idml.paragraphs(package_parts(_t(spark, sf_dir, "documents")))
    return p.select("doc_id", F.col("para_ix").cast("long").alias("para_ix"), classify.raw_text(F.col("runs")).alias("text"))


@_query("SELECT 'doc' || doc_id || '.idml' AS doc_id, 1::BIGINT AS stories, 1::BIGINT AS spreads, 1::BIGINT AS pages, 1::BIGINT AS frames, false AS threaded, false AS double_column_frames FROM documents")
def package_inspect(spark, sf_dir):
    """What is in each package."""
    from .convert import inspect

    return inspect(package_parts(_t(spark, sf_dir, "documents")))


@_query(f"""WITH l AS (SELECT doc_id, para_ix, trim(text) AS text FROM {_LINES} WHERE trim(text) <> ''),
t AS (SELECT *, lag(text) OVER w AS prev, CASE WHEN regexp_matches(text, '^\\s*\\(?[A-Da-d1-4][\\).]\\s+') AND length(text) < 200 OR regexp_matches(text, '^\\s*(Q\\.?\\s*\\d+|Question\\s*\\d+|\\d+\\.)\\s', 'i') THEN 0 ELSE 1 END AS para FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY para_ix)),
s AS (SELECT *, CASE WHEN para = 1 AND lag(para) OVER w = 1 AND right(prev, 1) NOT IN ('.', '!', '?', ':', ';', chr(8221), '"', ')') THEN 0 ELSE 1 END AS start FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY para_ix))
SELECT 'doc' || doc_id || '.idml' AS doc_id, (sum(length(text)) + count(*) - sum(start))::BIGINT AS characters, sum(start)::BIGINT AS text_blocks, ceil((sum(length(text)) + count(*) - sum(start)) / 4.0)::BIGINT AS tokens FROM s GROUP BY doc_id""")
def package_convert(spark, sf_dir):
    """The whole conversion of packages made of the documents: order, expansion, cleaning, grouping, statistics."""
    from .convert import convert

    return convert(package_parts(_t(spark, sf_dir, "documents"))).stats.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("characters", "text_blocks", "tokens")))


# -- pages -------------------------------------------------------------------------------------------------------------

_ENT = "html"
for _n, _c in pages_source.ENTITIES:
    _ENT = f"replace({_ENT}, '{_n}', '{_c}')"


@_query("""SELECT page_id, CASE WHEN regexp_extract(html, '<h1>(.*?)</h1>', 1) <> '' THEN regexp_extract(html, '<h1>(.*?)</h1>', 1) ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS title FROM pages""")
def doc_titles(spark, sf_dir):
    """The first of a page's candidates for a title."""
    h1, title = pages_source.headings("h1"), pages_source.headings("title")
    return _t(spark, sf_dir, "pages").select("page_id", F.when(h1 != "", h1).otherwise(title).alias("title"))


_PARAS = """(SELECT page_id, i - 2 AS para_ix, string_split(a[i], '</p>')[1] AS html FROM (SELECT page_id, string_split(CASE WHEN contains(html, '<article>') THEN string_split(string_split(html, '<article>')[-1], '</article>')[1] ELSE html END, '<p>') AS a FROM pages), unnest(generate_series(2, len(a))) AS t(i))"""


@_query(f"SELECT page_id, para_ix::BIGINT AS para_ix, html FROM {_PARAS}")
def page_blocks(spark, sf_dir):
    """A page's paragraphs, with their place."""
    return pages_source.page_paragraphs(_t(spark, sf_dir, "pages")).withColumns(_long("para_ix"))


@_query(f"""WITH b AS (SELECT page_id, para_ix, html, false AS head FROM {_PARAS} UNION ALL SELECT page_id, -1, regexp_extract(html, '<h1>(.*?)</h1>', 1), true FROM pages WHERE contains(html, '<h1>')),
s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY para_ix) AS section_ix FROM b)
SELECT page_id, section_ix::BIGINT AS section_ix, trim(arg_min(CASE WHEN head THEN html ELSE '' END, para_ix)) AS title, count(*)::BIGINT AS children FROM s GROUP BY page_id, section_ix""")
def page_sections(spark, sf_dir):
    """Headings of pages open sections."""
    p = _t(spark, sf_dir, "pages")
    paras = pages_source.page_paragraphs(p).select(F.col("page_id").alias("doc_id"), F.col("para_ix").alias("order_key"), F.lit("paragraph").alias("type"), F.col("html").alias("text"))
    heads = p.where(F.contains("html", F.lit("<h1>"))).select(F.col("page_id").alias("doc_id"), F.lit(-1).alias("order_key"), F.lit("heading").alias("type"), pages_source.headings("h1").alias("text"))
    blocks = paras.unionByName(heads).withColumn("block_kind", F.lit("text"))
    out = sections.sections(sections.section_blocks(blocks))
    return out.select(F.col("doc_id").alias("page_id"), F.col("section_ix").cast("long").alias("section_ix"), "title", "children")


@_query(f"SELECT page_id, para_ix::BIGINT AS para_ix, regexp_replace({_ENT}, '<[^>]*>', '', 'g') AS text FROM {_PARAS}")
def page_text_clean(spark, sf_dir):
    """paragraphs as plain text."""
    p = pages_source.page_paragraphs(_t(spark, sf_dir, "pages"))
    return p.select("page_id", F.col("para_ix").cast("long").alias("para_ix"), pages_source.strip_tags(pages_source.unescape(F.col("html"))).alias("text"))


@_query("""SELECT page_id, (i - 1)::BIGINT AS link_ix, a[i] AS href FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS a FROM pages), unnest(generate_series(1, len(a))) AS t(i)""")
def page_links(spark, sf_dir):
    """References of each page."""
    return pages_source.links(_t(spark, sf_dir, "pages")).withColumns(_long("link_ix"))


@_query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, regexp_replace(href, '^.*/', '') AS name FROM (SELECT page_id, regexp_replace(href, '/+$', '') AS href FROM l)""")
def page_link_names(spark, sf_dir):
    """Distinct basenames of references."""
    return pages_source.links(_t(spark, sf_dir, "pages")).select("page_id", file_name(F.col("href")).alias("name")).distinct()


@_query("""WITH l AS (SELECT page_id, i, a[i] AS item, len(a) AS n FROM (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS a FROM pages), unnest(generate_series(1, len(a))) AS t(i))
SELECT page_id, (i - 1)::BIGINT AS item_ix, item, i = 1 AS opens, i = n AS closes FROM l""")
def page_list_items(spark, sf_dir):
    """List items, and which open and close their list."""
    p = _t(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li>(.*?)</li>"), 1)).alias("item_ix", "item"))
    w = sequence.window(["page_id"], ["item_ix"])
    return p.select("page_id", F.col("item_ix").cast("long").alias("item_ix"), "item", F.lag("item").over(w).isNull().alias("opens"), F.lead("item").over(w).isNull().alias("closes"))


@_query(f"""SELECT page_id, string_agg('<p>' || replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</p>', '' ORDER BY para_ix) AS html FROM {_PARAS} GROUP BY page_id""")
def page_render(spark, sf_dir):
    """Paragraphs rendered in order."""
    p = pages_source.page_paragraphs(_t(spark, sf_dir, "pages")).withColumn("h", H.tagged("p", H.esc(F.col("html"), quote=False)))
    return p.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("para_ix", "h"))), lambda x: x["h"]), "").alias("html"))


@_query("""SELECT page_id, lower(trim(regexp_extract(replace(url, '\\', '/'), '([^/]*)/*$', 1))) AS name FROM pages""")
def url_basename(spark, sf_dir):
    """the lookup key of a reference."""
    return _t(spark, sf_dir, "pages").select("page_id", link_key(F.col("url")).alias("name"))


@_query("""SELECT page_id, CASE WHEN s = '' THEN 'asset' ELSE s END AS stem FROM (SELECT page_id, regexp_replace(regexp_replace(CASE WHEN strpos(substr(n, 2), '.') > 0 THEN regexp_replace(n, '\\.[^.]*$', '') ELSE n END, '[^A-Za-z0-9_.-]+', '_', 'g'), '^_+|_+$', '', 'g') AS s
  FROM (SELECT page_id, regexp_extract(url, '([^/]*)/*$', 1) AS n FROM pages))""")
def safe_names(spark, sf_dir):
    """file stems for outputs."""
    return _t(spark, sf_dir, "pages").select("page_id", safe_stem(F.col("url")).alias("stem"))


# -- reading order over conversations ----------------------------------------------------------------------------------

_FRAMES = "(SELECT conv_id, turn, role, CASE WHEN turn = 0 THEN '' ELSE (turn - 1)::VARCHAR END AS prev FROM conversations)"


def _frames(spark, sf_dir, stories: bool = True) -> DataFrame:
    """Conversations as frames: a turn is a frame, a role a story, its page three turns, its column even or odd."""
    c = _t(spark, sf_dir, "conversations")
    t = F.col("turn").cast("int")
    return c.select(
        F.col("conv_id").cast("string").alias("doc_id"), t.alias("frame_ix"), t.cast("string").alias("self_id"), F.lit("text").alias("kind"), F.col("role").alias("story_id"), (t % 3 * 10).cast("double").alias("x"), F.length("text").cast("double").alias("y"),
        F.lit(1.0).alias("width"), F.lit(1.0).alias("height"), F.floor(t / 3).cast("int").alias("page_index"), F.lit("").alias("page_name"), F.lit(1).alias("column_count"), F.when(t == 0, "").otherwise((t - 1).cast("string")).alias("prev_frame"), F.lit("").alias("next_frame"), F.lit("").alias("link_uri"), (t % 2).alias("col"),
    )


def _placed(df: DataFrame) -> DataFrame:
    return df.select("doc_id", F.col("placement_ix").cast("long").alias("placement_ix"), "story_id", F.col("frame_ix").cast("long").alias("frame_ix"))


def _order_sql(rank: str, place: str) -> str:
    return f"""WITH f AS (SELECT conv_id::VARCHAR AS doc_id, turn AS ix, role, (turn // 3) AS page, turn % 2 AS col, length(text)::DOUBLE AS y, (turn % 3 * 10)::DOUBLE AS x, turn = 0 AS st FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY {rank}) AS r FROM f)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY {place}) - 1)::BIGINT AS placement_ix, role AS story_id, ix::BIGINT AS frame_ix FROM p WHERE r = 1"""


@_query(_order_sql("page, col, y, x, ix", "page, col, y, x, ix"))
def thread_emit_once(spark, sf_dir):
    """W1 (analogy): each story once, by position."""
    return _placed(order.place(_frames(spark, sf_dir), "geometric"))


@_query(_order_sql("st DESC, page, col, y, x, ix", "page, col, y, x, CASE WHEN st THEN 0 ELSE 1 END, ix"))
def thread_placement(spark, sf_dir):
    """W2, J3 (analogy): each story where its chain starts."""
    return _placed(order.place(_frames(spark, sf_dir), "threaded"))


@_query(_order_sql("ix", "CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 10000 END, ix"))
def story_rank_order(spark, sf_dir):
    """W3 (analogy): stories by a list, others after."""
    f = _frames(spark, sf_dir)
    listed = f.select("doc_id").distinct().select("doc_id", F.explode(F.array(F.struct(F.lit("assistant").alias("story_id"), F.lit(0).alias("story_ix")), F.struct(F.lit("user").alias("story_id"), F.lit(1).alias("story_ix")))).alias("s")).select("doc_id", "s.*")
    return _placed(order.place(f, "story_order", listed))


@_query(f"""WITH f AS (SELECT conv_id::VARCHAR AS doc_id, turn AS ix, role, (turn // 3) AS page, turn % 2 AS col, length(text)::DOUBLE AS y, (turn % 3 * 10)::DOUBLE AS x, turn = 0 AS st, max(turn) OVER (PARTITION BY conv_id) > 0 AS th FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, role ORDER BY (th AND st) DESC, page, col, y, x, ix) AS r FROM f)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page, col, y, x, CASE WHEN st THEN 0 ELSE 1 END, ix) - 1)::BIGINT AS placement_ix, role AS story_id, ix::BIGINT AS frame_ix FROM p WHERE r = 1""")
def auto_order(spark, sf_dir):
    """W4 (analogy): threaded where there are threads."""
    return _placed(order.place(_frames(spark, sf_dir), "auto"))


# -- sequences over events ---------------------------------------------------------------------------------------------


@_query("""WITH e AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e) SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*)::BIGINT AS n, min(event_id) AS first_event FROM i GROUP BY user_id, run""")
def anchored_runs(spark, sf_dir):
    """W8 (analogy): maximal runs of equal type."""
    e = sequence.runs_of_equal(_t(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type", "run")
    return e.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@_query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def carry_forward(spark, sf_dir):
    """W16 (analogy): the last purchase's value, carried on."""
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return sequence.carry_forward(e, ["user_id"], ["event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "last_purchase").select("event_id", "last_purchase")


@_query("""WITH e AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY event_id) AS session FROM e) SELECT user_id, session::BIGINT AS session, count(*)::BIGINT AS n, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END)::BIGINT AS clicks FROM i GROUP BY user_id, session""")
def gap_sessions(spark, sf_dir):
    """W18 (analogy): sessions with gaps of at most 30 minutes."""
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = sequence.gap_sessions(e, ["user_id"], ["event_id"], F.col("us"), 1_800_000_000, "session")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@_query("""SELECT event_type, count(*)::BIGINT AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS large, round_even(100.0 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*), 1) AS large_pct, bool_and(value IS NOT NULL) AS complete FROM events GROUP BY event_type""")
def event_coverage(spark, sf_dir):
    """A2, A9 (analogy): conditional counts and shares."""
    e = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.bool_and(F.col("value").isNotNull()).alias("complete"))
    return e.withColumn("large_pct", percent(F.col("large"), F.col("n")))


@_query("""WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id AS click_id, user_id, ts AS cts FROM events WHERE event_type = 'click'),
j AS (SELECT p.event_id, click_id, abs(epoch_us(ts) - epoch_us(cts)) AS d FROM p JOIN c ON p.user_id = c.user_id AND abs(epoch_us(ts) - epoch_us(cts)) <= 86400000000)
SELECT event_id, click_id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY d, click_id) AS r FROM j) WHERE r = 1""")
def nearest_event(spark, sf_dir):
    """J11 (analogy): the nearest click of a purchase within a day, by two running windows instead of pairs."""
    e = _t(spark, sf_dir, "events").where("event_type in ('purchase', 'click')").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    near = e.withColumn("near", sequence.nearest_value(e, ["user_id"], "us", F.col("event_type") == "click", F.col("event_id")))
    return near.where((F.col("event_type") == "purchase") & (F.col("near.d") <= 86_400_000_000)).select("event_id", F.col("near.id").alias("click_id"))


# -- lookups and helpers over the star schema --------------------------------------------------------------------------


@_query("""WITH b AS (SELECT n_nationkey AS k, n_nationkey * 40.0 AS x, n_nationkey * 40.0 + 30 AS x1 FROM nation),
j AS (SELECT s_suppkey, k, CASE WHEN v BETWEEN x AND x1 THEN 0 ELSE 1 END AS o, CASE WHEN v BETWEEN x AND x1 THEN 0 ELSE (v - (x + x1) / 2) * (v - (x + x1) / 2) END AS d FROM (SELECT s_suppkey, abs(s_acctbal) / 10 AS v FROM supplier), b)
SELECT s_suppkey, k::BIGINT AS box FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY o, d, k) AS r FROM j) WHERE r = 1""")
def page_assignment(spark, sf_dir):
    """J4 (analogy): points to the box that holds them, or else the nearest. Boxes are a fixed few."""
    boxes = _t(spark, sf_dir, "nation").select(F.lit(1).alias("g"), F.col("n_nationkey").alias("box_ix"), (F.col("n_nationkey") * 40.0).alias("x_offset"), F.lit(0.0).alias("y_offset"), F.lit(30.0).alias("width"), F.lit(1.0).alias("height"))
    pts = _t(spark, sf_dir, "supplier").select("s_suppkey", F.lit(1).alias("g"), (F.abs("s_acctbal") / 10).alias("v"))
    out = lookup.nearest_box(pts, F.broadcast(boxes), ["g"], F.col("v"), F.lit(0.5), ["box_ix"])
    return out.select("s_suppkey", F.col("_box.box_ix").cast("long").alias("box"))


@_query("""SELECT o_orderkey, l_partkey, l_quantity FROM orders JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r FROM lineitem) ON o_orderkey = l_orderkey WHERE r = 1""")
def first_per_order(spark, sf_dir):
    """W1 at scale (helper): the first line of each order. The first row is an aggregate, so nothing is sorted."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("f"))
    return _t(spark, sf_dir, "orders").select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", F.col("f.l_partkey").alias("l_partkey"), F.col("f.l_quantity").alias("l_quantity"))


@_query("""WITH d AS (SELECT l_shipdate::DATE AS day, count(*) AS n FROM lineitem GROUP BY 1) SELECT day, n::BIGINT AS n, coalesce(sum(n) OVER (PARTITION BY year(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM d""")
def page_base(spark, sf_dir):
    """W19 (helper): running offsets within a year."""
    d = _t(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count("*").alias("n")).withColumn("y", F.year("day"))
    return sequence.running_before(d, ["y"], ["day"], "n", "base").drop("y")


@_query("""WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS h, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem),
s AS (SELECT *, sum(h) OVER (PARTITION BY l_orderkey ORDER BY i) AS section FROM l) SELECT l_orderkey, section::BIGINT AS section, count(*)::BIGINT AS n FROM s GROUP BY l_orderkey, section""")
def sections_over_lineitem(spark, sf_dir):
    """W11 at scale (helper): returned lines open sections of an order."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")
    s = sequence.islands(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"], F.col("l_returnflag") == "R", "section")
    return s.groupBy("l_orderkey", "section").agg(F.count("*").alias("n"))


@_query("""WITH k AS (SELECT p_partkey, lower(trim(replace(regexp_replace(p_name, '^[\\d_\\-\\s]+', ''), '_', ' '))) AS k FROM part), v AS (SELECT p_partkey, k, regexp_replace(k, 's+$', '') AS s FROM k)
SELECT p_partkey, list_sort(list_filter(list_distinct([k, k || 's', s, s || 's']), lambda x: x <> ''))::VARCHAR AS variants FROM v""")
def title_variants(spark, sf_dir):
    """U4: names that a title may have."""
    v = F.array_sort(sections.title_variants(sections.title_key(F.col("p_name"))))
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(v, ", "), F.lit("]")).alias("variants"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 0 ELSE 1 END::BIGINT AS late, (row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 0 ELSE 1 END, o_orderkey) - 1)::BIGINT AS place FROM orders""")
def stable_partition(spark, sf_dir):
    """L4 (helper): flagged rows first, each side in its order."""
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").rlike("^[12]").alias("f"))
    out = sequence.stable_partition(o, ["o_custkey"], F.col("f"), ["o_orderkey"], "place")
    return out.select("o_orderkey", (~F.col("f")).cast("long").alias("late"), F.col("place").cast("long").alias("place"))


@_query("""WITH o AS (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS ix, o_orderstatus = 'O' AS s FROM orders),
e AS (SELECT *, CASE WHEN s THEN ix + 2 END AS stop FROM o), r AS (SELECT *, max(stop) OVER (PARTITION BY o_custkey ORDER BY ix) AS reach FROM e) SELECT o_custkey, o_orderkey FROM r WHERE reach IS NULL OR reach <= ix""")
def delete_ranges(spark, sf_dir):
    """P12 (helper): ranges of rows deleted from a sequence, the union of all that were opened."""
    o = sequence.renumber(_t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"], "ix")
    return sequence.delete_ranges(o, ["o_custkey"], "ix", F.when(F.col("o_orderstatus") == "O", F.col("ix") + 2)).select("o_custkey", "o_orderkey")


@_query("""SELECT p_partkey, least(0.0, p_size::DOUBLE) + 10.0 AS x, 20.0::DOUBLE AS y, abs(p_size::DOUBLE) AS width, p_retailprice AS height FROM part""")
def frame_boxes(spark, sf_dir):
    """F7-F10 (analogy): bounding boxes of transformed bounds."""
    b = F.concat(F.lit("0 0 "), F.col("p_retailprice").cast("string"), F.lit(" "), F.col("p_size").cast("string"))
    return _t(spark, sf_dir, "part").select("p_partkey", bounding_box(b, F.lit("1 0 0 1 10 20")).alias("r")).select("p_partkey", "r.*")


@_query("""WITH u AS (SELECT page_id AS doc_id, 'title_present' AS chk, contains(html, '<title>') AS ok, true AS is_error FROM pages UNION ALL SELECT page_id, 'body_closed', contains(html, '</body>'), false FROM pages UNION ALL SELECT page_id, 'has_article', contains(html, '<article>'), true FROM pages)
SELECT doc_id, bool_and(ok OR NOT is_error) AS passed, coalesce(string_agg(CASE WHEN NOT ok AND NOT is_error THEN chk END, ',' ORDER BY chk), '') AS warnings, coalesce(string_agg(CASE WHEN NOT ok AND is_error THEN chk END, ',' ORDER BY chk), '') AS errors FROM u GROUP BY doc_id""")
def qa_report(spark, sf_dir):
    """Rules stacked to a long table, then verdicts."""
    p = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html")
    rule = lambda name, tag, err: p.select("doc_id", F.lit(name).alias("check"), F.contains("html", F.lit(tag)).alias("ok"), F.lit(err).alias("is_error"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("detail"))
    v = qa.verdicts(qa.report([rule("title_present", "<title>", True), rule("body_closed", "</body>", False), rule("has_article", "<article>", True)]))
    return v.select("doc_id", "passed", F.array_join("warnings", ",").alias("warnings"), F.array_join("errors", ",").alias("errors"))


@_query("""SELECT page_id, CASE WHEN l.quality IS NULL THEN 'Link file not found' ELSE '' END AS note, (l.quality IS NOT NULL) AS found FROM pages LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON page_id = l.doc_id""")
def asset_notes(spark, sf_dir):
    """J6 (analogy): references resolved once each against the files there are."""
    p = _t(spark, sf_dir, "pages")
    refs = p.select(F.col("page_id").alias("doc_id"), F.concat(F.lit("file:Links/"), F.col("page_id").cast("string"), F.lit("%2Epng")).alias("link_uri"))
    files = _t(spark, sf_dir, "labels").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit(".PNG ")).alias("name")).withColumn("path", F.trim("name"))
    out = lookup.resolve_assets(refs, files, refs)
    return out.select(F.substring_index("original_name", ".", 1).cast("long").alias("page_id"), "note", "found")
