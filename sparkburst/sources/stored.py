"""Steps that several branches of a plan read, written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Tables of each block of ``passing`` that is open.
_PASSING: list[list[tuple[SparkSession, str]]] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or in a local session without it a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sparkburst-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: its sources are read once however often it is used, and a lost executor costs its own tasks only.

    The files go when the session's process ends, or with the block of ``passing`` around.
    """
    path = _kept(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _kept(spark: SparkSession) -> str:
    """A new path, whose files go later."""
    path = f"{shared_folder(spark)}/sparkburst-{uuid.uuid4().hex}"
    if _PASSING:
        _PASSING[-1].append((spark, path))
    else:
        atexit.register(_remove, spark, path)
    return path


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Tables that are stored inside go at the end of the block."""
    mine: list[tuple[SparkSession, str]] = []
    _PASSING.append(mine)
    try:
        yield
    finally:
        _PASSING[:] = [tables for tables in _PASSING if tables is not mine]
        for spark, path in mine:
            _remove(spark, path)


def stored_parts(spark: SparkSession, schema: str, parts: Iterator[DataFrame]) -> DataFrame:
    """All ``parts`` as one Parquet table, each written before the next is asked for; the plan stays the same however many there are."""
    path = _kept(spark)
    spark.createDataFrame([], schema).write.parquet(path)
    for part in parts:
        part.write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)
