"""Shared storage of intermediate tables, sessions and small conveniences."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from functools import wraps

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none (a single-machine session, as in tests) is a temporary folder used.
    """
    have = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if have:
        return have.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _own[app] = "file://" + tempfile.mkdtemp(prefix="quire-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # the session is gone; its folder goes with it
            return


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The shared folder as tasks see it, and its path there."""
    return pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else "file://" + folder)


def trimmed(run):
    """A pass over Arrow batches that gives its memory back when done: workers are reused, and would keep it."""

    @wraps(run)
    def passed(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # a C library without it
                pass

    return passed


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_row_key(docs: DataFrame, *extra: str, least: int = 0) -> DataFrame:
    """(rk_id, rk_hash, text, ...): a key for each distinct row of (doc_id, text).

    Rows alike in both are alike in every result here, so they may share a key; rows that share only the
    doc_id, and rows with none (rk_id is then the largest long), stay apart by the hash. Texts of fewer than ``least``
    bytes can have no place to be found under their key, so theirs is salted: a mass of empty texts is spread.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    short = F.coalesce(F.octet_length("text"), F.lit(0)) < least
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("rk_id"),
        F.when(short, F.xxhash64(key, F.rand(11))).otherwise(key).alias("rk_hash"),
        F.col("doc_id"),
        F.col("text"),
        *extra,
    )
