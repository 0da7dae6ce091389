"""Finding packages and reading their parts, for many packages in one job."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire import schema
from quire.functions.text import file_name, unquote

FONT_EXTENSIONS = ("ttf", "otf", "ttc")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, dir, name, ext, depth, length) of every file below ``root``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    name = file_name(F.col("path"))
    return files.select(
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        name.alias("name"),
        F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1)).otherwise("")).alias("ext"),
        F.size(F.split("path", "/")).alias("depth"),
        "length",
    )


def batch_folders(files: DataFrame) -> DataFrame:
    """Every folder that holds a package: the units of a batch."""
    return files.where("ext = 'idml'").select("dir").distinct()


def nearest_packages(files: DataFrame) -> DataFrame:
    """The packages of the folder of the shallowest one, first by path among equals."""
    idml = files.where("ext = 'idml'")
    first = idml.agg(F.min_by("dir", F.struct("depth", "path")).alias("dir"))
    return idml.join(F.broadcast(first), "dir")  # one row


def discover(files: DataFrame) -> DataFrame:
    """One row a folder with a package: the package, its siblings, fonts, and what is missing."""
    units = batch_folders(files)
    own = files.join(units, "dir")
    pick = lambda ext: F.min(F.when(F.col("ext") == ext, F.col("path")))
    main = own.groupBy("dir").agg(pick("idml").alias("idml_file"), pick("indd").alias("indd_file"), pick("pdf").alias("reference_pdf"), F.count_if(F.col("ext") == "idml").alias("packages"))
    below = files.withColumn("folder", file_name(F.col("dir"))).withColumn("parent", F.regexp_replace("dir", "/[^/]*$", ""))
    links = below.where("folder = 'Links'").groupBy(F.col("parent").alias("dir")).agg(F.first("dir").alias("links_dir"))
    # of two spellings of the fonts folder the first wins
    fonts = below.where(F.col("folder").isin("Document fonts", "Document Fonts")).groupBy(F.col("parent").alias("dir")).agg(
        F.max("dir").alias("fonts_dir"), F.sort_array(F.collect_set(F.when(F.col("ext").isin(*FONT_EXTENSIONS), F.col("name")))).alias("fonts")
    )
    out = main.join(links, "dir", "left").join(fonts, "dir", "left")
    warnings = F.filter(
        F.array(
            F.when(F.col("packages") > 1, F.concat(F.lit("Multiple packages found; using "), file_name(F.col("idml_file")))),
            F.when(F.col("links_dir").isNull(), F.lit("No Links folder found; images may be missing.")),
            F.when(F.col("fonts_dir").isNull(), F.lit("No 'Document fonts' folder found; fonts will fall back.")),
        ),
        lambda x: x.isNotNull(),
    )
    return out.select("dir", "idml_file", "indd_file", "reference_pdf", "links_dir", "fonts_dir", F.coalesce("fonts", F.array().cast("array<string>")).alias("fonts"), warnings.alias("warnings"))


def unpack(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``parts`` of every package: one row a part. A file that is no package, or lacks its map, is an error row.

    Errors have part_name ``!error`` and the message as body, so one bad package does not end a batch.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.idml").load(paths).select("path", "content")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.binary()))], ["doc_id", "part_name", "body"])

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        if "designmap.xml" not in names:
                            raise ValueError("the package has no designmap.xml")
                        yield out([(path, n, z.read(n)) for n in names])
                except (zipfile.BadZipFile, ValueError) as e:
                    yield out([(path, "!error", str(e).encode())])

    return files.mapInArrow(parts, schema.PARTS)


def parts_like(parts: DataFrame, pattern: str) -> DataFrame:
    return parts.where(F.col("part_name").rlike(pattern))


def stories(parts: DataFrame) -> DataFrame:
    return parts_like(parts, r"^Stories/Story_.*\.xml$")


def spreads(parts: DataFrame) -> DataFrame:
    return parts_like(parts, r"^Spreads/Spread_.*\.xml$")


def referenced_links(parts: DataFrame, scope: str = "^Spreads/") -> DataFrame:
    """(doc_id, name): distinct basenames of the links in the spreads (or another ``scope`` of parts)."""
    text = F.decode("body", "UTF-8")
    uri = F.explode(F.regexp_extract_all(text, F.lit('LinkResourceURI="([^"]+)"'), 1)).alias("uri")
    return parts_like(parts, scope + r".*\.xml$").select("doc_id", uri).select("doc_id", file_name(unquote(F.col("uri"))).alias("name")).distinct()


def check_links(parts: DataFrame, links: DataFrame, scope: str = "^Spreads/") -> DataFrame:
    """(doc_id, name, present): whether each referenced link is among the files ``links(doc_id, name)``."""
    have = links.select("doc_id", "name").distinct().withColumn("present", F.lit(True))
    return referenced_links(parts, scope).join(have, ["doc_id", "name"], "left").select("doc_id", "name", F.coalesce("present", F.lit(False)).alias("present"))


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of the last ``order`` for each key."""
    w = W.partitionBy(*keys)
    return rows.withColumn("_last", F.max(order).over(w)).where(F.col(order) == F.col("_last")).drop("_last")
