"""Reading and writing the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CASE_SUMMARY = "case string, methods string, n_methods int, recovered long, total long, coverage double, union_fp long"
DETECTION_VOTES = "sample_idx long, label int, votes int, methods string"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_labelled_spectrograms(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, label, spec, ...) from Parquet; spectrogram cells as floats."""
    return spark.read.parquet(path).withColumn("spec", F.col("spec").cast("array<array<float>>"))


def read_case_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=CASE_SUMMARY)


def read_detection_votes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=DETECTION_VOTES)


def read_spectrograms(spark: SparkSession, path: str) -> DataFrame:
    """Saved spectrograms with ``name``, the stem of their file."""
    return spark.read.parquet(path).withColumn("name", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1))


def write_spectrograms(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").partitionBy("kind", "probes").parquet(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def label_examples(rows: DataFrame, labels: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """The first sample of each label; a label without a sample is an error."""
    first = rows.where(F.col("label").isin(*labels)).groupBy("label").agg(F.min("sample_idx").alias("sample_idx"))
    missing = set(labels) - {r["label"] for r in first.select("label").collect()}
    if missing:
        raise ValueError(f"no sample with label {sorted(missing)}")
    return first


def first_channel(rows: DataFrame, spec: str = "spec", label: str = "label") -> str | None:
    """The first other column whose first row is a matrix of the shape of the first spectrogram."""
    others = [c for c, kind in rows.dtypes if c not in (spec, label, "sample_idx") and kind.startswith("array<array<")]
    head = rows.orderBy("sample_idx").limit(1).select(*[F.struct(F.size(c).alias("h"), F.size(F.col(c)[0]).alias("w")).alias(c) for c in [spec, *others]]).first()
    return next((c for c in others if head and head[c] == head[spec]), None)
