"""Scoring a stream of vectors against a fitted background."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.scores import array_sum


def score_stream(vectors: DataFrame, mean: list[float], std: list[float], threshold: float) -> DataFrame:
    """(sample_idx, score, detected) of a stream of (sample_idx, x): squared distance in deviations; stateless."""
    fit = F.arrays_zip(F.array(*map(F.lit, mean)).alias("m"), F.array(*[F.lit(s or 1.0) for s in std]).alias("s"))
    z = F.zip_with("x", fit, lambda v, f: F.pow((v - f["m"]) / f["s"], 2))
    return vectors.select("sample_idx", array_sum(z).alias("score")).withColumn("detected", F.col("score") >= threshold)


def alarms_per_window(scored: DataFrame, time: str = "ts", window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Detections per window of event time; rows later than ``late`` are dropped."""
    return scored.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.sum(F.col("detected").cast("long")).alias("n_detected"), F.count(F.lit(1)).alias("n_rows"))


def to_parquet(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return scored.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
