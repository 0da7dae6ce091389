"""Cuts in long plans: a table written to the folder that all machines share, and read back.

Plans that use one table several times would compute it as often; and a cut survives the loss of any executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where a single-machine session has none."""
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if have:
        return have.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quire-stage-")
    return _own[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df``, computed once."""
    path = f"{shared_folder(df.sparkSession)}/quire-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
