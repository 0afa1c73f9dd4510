"""The score bank: one row per sample and method, the table that the other operators share.

Columns: sample_idx, label (0 background, 1 and 2 the anomaly classes), y (label > 0),
method, score (higher: more anomalous).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running_sums

METHODS = ("head_energy", "l2_centroid", "max_abs_z", "mean_abs_z")


def labelled_vectors(embeddings: DataFrame) -> DataFrame:
    """sample_idx, label and a double array, from (vec_id, embedding, label 0 to 9): 8 and 9 are the anomaly classes."""
    label = F.when(F.col("label") == 8, 1).when(F.col("label") == 9, 2).otherwise(0)
    return embeddings.select(F.col("vec_id").alias("sample_idx"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def background_moments(vectors: DataFrame) -> DataFrame:
    """One row: arrays of the mean and population deviation of each dimension over the background."""
    cells = vectors.where("label = 0").select(F.posexplode("x").alias("d", "v"))
    per = cells.groupBy("d").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("d", "m", "s")))
    return per.agg(ordered.alias("p")).select(F.col("p.m").alias("mean"), F.col("p.s").alias("std"))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, b: a + b)


def score_bank(vectors: DataFrame) -> DataFrame:
    """Four distance scores of each vector from the background; scoring needs no shuffle."""
    with_moments = vectors.crossJoin(F.broadcast(background_moments(vectors)))  # one row, as long as a vector
    apart = F.zip_with("x", "mean", lambda a, b: a - b)
    z = F.zip_with(F.zip_with("x", "mean", lambda a, b: F.abs(a - b)), "std", lambda a, s: a / (s + 1e-9))
    wide = with_moments.select(
        "sample_idx", "label", (F.col("label") > 0).cast("int").alias("y"),
        array_sum(F.transform(F.slice("x", 1, 8), lambda v: v * v)).alias("head_energy"),
        F.sqrt(array_sum(F.transform(apart, lambda v: v * v))).alias("l2_centroid"),
        F.array_max(z).alias("max_abs_z"),
        (array_sum(z) / F.size("x")).alias("mean_abs_z"),
    )
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.round(m, 6).alias("score")) for m in METHODS])
    return wide.select("sample_idx", "label", "y", F.explode(pairs).alias("p")).select("sample_idx", "label", "y", "p.method", "p.score")


def background_split(rows: DataFrame, train: float = 0.8, calibrate: float = 0.2) -> DataFrame:
    """Background samples cut by the order of their id's md5 into train, cal and rest at the floors of the shares."""
    keyed = rows.where("label = 0").select("sample_idx", F.md5(F.col("sample_idx").cast("string").cast("binary")).alias("key"), F.lit(1).alias("one"), F.lit(0).alias("all"))
    head = keyed.withColumn("order", F.conv(F.substring("key", 1, 15), 16, 10).cast("long"))
    ranked = running_sums(head, ["all"], "order", ["one"])
    n = rows.where("label = 0").agg(F.count(F.lit(1)).alias("total"))
    first, second = F.floor(F.col("total") * train), F.floor(F.col("total") * train) + F.floor(F.col("total") * calibrate)
    part = F.when(F.col("below_one") < first, "train").when(F.col("below_one") < second, "cal").otherwise("rest")
    return ranked.crossJoin(F.broadcast(n)).select("sample_idx", part.alias("part"))
