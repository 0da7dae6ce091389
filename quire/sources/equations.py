"""The equation dimension: basenames of graphics and their LaTeX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import strip


def load(spark: SparkSession, path: str) -> DataFrame:
    """(basename, latex, display) from a JSON file: a map, at the top or under ``equations``, of strings or objects.

    Keys are trimmed and lower-cased; blank LaTeX is dropped; a file that is no such JSON gives no rows.
    """
    raw = spark.read.text(path, wholetext=True).select(F.col("value"))
    values = F.from_json(F.coalesce(F.get_json_object("value", "$.equations"), F.col("value")), "map<string,string>")
    rows = raw.select(F.explode(values).alias("key", "value"))
    is_object = F.col("value").startswith("{")
    latex = F.when(is_object, F.get_json_object("value", "$.latex")).otherwise(F.col("value"))
    display = F.when(is_object, F.get_json_object("value", "$.display").cast("boolean"))
    out = rows.select(F.lower(strip(F.col("key"))).alias("basename"), strip(latex).alias("latex"), display.alias("display"))
    return out.where("latex is not null and latex <> ''")
