"""Plain documents as paragraphs: a line is one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, para_ix, text): every line of every text, in order; a null text has none."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("para_ix", "text"))
