"""Shared pieces of the corpus operators: tables, materialised steps and distributed running sums."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a Python function gets at a time.
BATCH_ROWS = 2_048
#: Settings while a step is written: its shuffle files go as soon as the table is there, since nothing reads them any more.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Rows of a broadcast id list at most (ids or short digests, so 100 MB); beyond it joins shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or in a local session a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sparkburst-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored step's folder."""
    if spark.sparkContext._jsc is not None:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stored_step(df: DataFrame, codec: str = "zstd", batch_rows: int = BATCH_ROWS) -> tuple[DataFrame, str]:
    """``materialise`` with the folder's path, for steps that go as soon as the next one is written (``discard``)."""
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path = f"{shared_dir(spark)}/sparkburst-{uuid.uuid4().hex}"
    most = int(spark.conf.get(rows))
    during = WRITING | {rows: str(min(batch_rows, most) if most > 0 else batch_rows)}
    before = {name: spark.conf.get(name) for name in during}
    try:
        for name, value in during.items():
            spark.conf.set(name, value)
        df.write.option("compression", codec).parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    atexit.register(discard, spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, codec: str = "zstd", batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    It cuts the lineage, so a lost executor costs its own tasks only, and each step that
    is used twice is computed once. Its shuffle files go once it is written, its own files
    when the session's process ends. While it writes, Python functions get ``batch_rows``
    rows at a time, so that batches of whole texts stay small in the JVM and in Python.
    """
    return stored_step(df, codec, batch_rows)[0]


def narrow(ids: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a list of keys, a few numbers a row, if its counted size allows it."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def block_offsets(blocks: DataFrame, keys: list[str], block: str, value: str, bits: int = 12) -> DataFrame:
    """Exclusive running sum of ``value`` over ``block`` (a long) within ``keys``, in two levels.

    No window holds more than 2**bits blocks of one outer block, nor more rows than there
    are outer blocks.
    """
    outer = F.shiftright(F.col(block), bits)
    per = blocks.withColumn("_outer", outer)
    tops = per.groupBy(*keys, "_outer").agg(F.sum(value).alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_outer").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(*keys, "_outer", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_above"))
    within = Window.partitionBy(*keys, "_outer").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_inner", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return per.join(tops, [*keys, "_outer"]).select(*keys, block, (F.col("_inner") + F.col("_above")).alias("_base"))


def running_offsets(df: DataFrame, keys: list[str], block: Column, order: list[Column | str], value: str, name: str) -> DataFrame:
    """Add ``name``: the exclusive running sum of ``value`` within ``keys``, in order of (block, *order).

    ``block`` is a non-negative long that splits each key evenly, so a key that holds a
    third of the rows is summed by many tasks: rows within blocks, then block totals.
    """
    df = df.withColumn("_block", block)
    base = block_offsets(df.groupBy(*keys, "_block").agg(F.sum(value).alias("_total")), keys, "_block", "_total")
    before = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_local", F.coalesce(F.sum(value).over(before), F.lit(0)))
    return df.join(base, [*keys, "_block"]).withColumn(name, F.col("_local") + F.col("_base")).drop("_block", "_local", "_base")


def hash_block(*columns: Column | str, bits: int = 20) -> Column:
    """An even split of rows into 2**bits blocks by a stable hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 64 - bits)
