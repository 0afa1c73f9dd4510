"""Contrastive losses of pairs of vectors within batches of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scores import array_sum


def normalised(vectors: DataFrame) -> DataFrame:
    norm = F.sqrt(array_sum(F.transform("x", lambda v: v * v)))
    return vectors.withColumn("x", F.transform("x", lambda v: v / F.greatest(norm, F.lit(1e-12))))


def batch_losses(pairs: DataFrame, temperature: float = 0.1) -> DataFrame:
    """Per batch of (batch, i, x): vectors 2j and 2j + 1 are two views of one thing.

    ``info_nce`` leaves a vector's likeness to itself out of the softmax, ``contrastive``
    keeps it. Batches are small by construction; rows meet within their batch only.
    """
    unit = normalised(pairs)
    listed = unit.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    rows = listed.select("batch", "v", F.explode("v").alias("a"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    sims = rows.select("batch", F.col("a.i").alias("i"), F.transform("v", lambda b: F.struct(b["i"].alias("i"), (dot(F.col("a.x"), b["x"]) / temperature).alias("s"))).alias("sims"))
    mate = F.col("i").bitwiseXOR(F.lit(1))
    total = lambda values: F.log(F.aggregate(values, F.lit(0.0), lambda s, p: s + F.exp(p["s"])))
    positive = F.element_at(F.filter("sims", lambda p: p["i"] == mate), 1)["s"]
    losses = sims.select("batch", (total(F.filter("sims", lambda p: p["i"] != F.col("i"))) - positive).alias("n"), (total(F.col("sims")) - positive).alias("c"))
    return losses.groupBy("batch").agg(F.avg("n").alias("info_nce"), F.avg("c").alias("contrastive"))
