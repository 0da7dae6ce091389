"""Sinks: pages, statistics and reports, written by the executors."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.config import MobileProfile
from quire.operators.render import style_sheet
from quire.operators.sections import stem_of


def guard_output(out: str, inputs: list[str]) -> None:
    """Refuse to write into a source package's folder."""
    norm = lambda p: re.sub(r"^file:/*", "/", p).rstrip("/")
    for i in inputs:
        folder = norm(i)
        if norm(out) == folder or folder.endswith(".idml") and norm(out) == folder.rpartition("/")[0]:
            raise ValueError("the output would overwrite the source package")


def output_folders(docs: DataFrame) -> DataFrame:
    """(doc_id, document): the name of each document's folder, its file's stem; stems that several have get a mark of the id."""
    d = docs.select("doc_id", stem_of(F.col("doc_id")).alias("stem")).distinct()
    many = F.count("*").over(W.partitionBy("stem")) > 1
    return d.select("doc_id", F.when(many, F.concat("stem", F.lit("-"), F.substring(F.sha2("doc_id", 256), 1, 8))).otherwise(F.col("stem")).alias("document"))


def write_pages(html: DataFrame, out: str, inputs: list[str] = ()) -> None:
    """One text file a document, in a folder of its own: ``out/document=<stem>/``. ``inputs``: paths not to write into."""
    guard_output(out, list(inputs))
    named = html.join(output_folders(html), "doc_id").select("document", F.col("html").alias("value"))
    named.repartition("document").write.mode("overwrite").partitionBy("document").text(out)


def write_styles(spark, out: str, profile: MobileProfile | None = None, faces=()) -> None:
    spark.createDataFrame([(style_sheet(profile, faces),)], "value string").coalesce(1).write.mode("overwrite").text(out)


def write_json(df: DataFrame, out: str) -> None:
    """Statistics, coverage or a report as JSON lines."""
    df.write.mode("overwrite").json(out)
