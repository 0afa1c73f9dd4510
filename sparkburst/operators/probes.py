"""Supervised probes by MLlib: logistic regression, random forest and boosted trees, scored out of fold."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .ordered import running_sums


def folds(vectors: DataFrame, n: int = 5) -> DataFrame:
    """Add ``fold`` and ``weight``: rows of each class are dealt round in the order of their id's hash, and both classes weigh the same."""
    counts = vectors.groupBy("y").agg(F.count(F.lit(1)).alias("_c"))
    total = vectors.count()
    placed = running_sums(vectors.select("sample_idx", "y", F.xxhash64("sample_idx").alias("_hash"), F.lit(1).alias("one")), ["y"], "_hash", ["one"], ("sample_idx",))
    dealt = placed.select("sample_idx", "y", F.pmod("below_one", F.lit(n)).cast("int").alias("fold"))
    return vectors.join(F.broadcast(counts), "y").withColumn("weight", F.lit(float(total)) / (2 * F.col("_c"))).drop("_c").join(dealt, ["sample_idx", "y"])


def out_of_fold(vectors: DataFrame, kind: str = "logistic", n: int = 5) -> DataFrame:
    """(sample_idx, y, score): each fold scored by a model of the others.

    There are at most as many folds as the smaller class has rows; with fewer than two, or
    one class only, every score is one half.
    """
    sizes = [r["n"] for r in vectors.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()]
    n = min(n, *sizes) if len(sizes) == 2 else 0
    if n < 2:
        return vectors.select("sample_idx", "y", F.lit(0.5).alias("score"))
    data = stored(folds(vectors, n)).withColumn("features", array_to_vector("x"))
    common = {"featuresCol": "features", "labelCol": "y", "weightCol": "weight"}
    make = {
        "logistic": lambda: LogisticRegression(maxIter=50, regParam=0.01, **common),
        "forest": lambda: RandomForestClassifier(numTrees=200, featureSubsetStrategy="sqrt", seed=42, **common),
        "boosted": lambda: GBTClassifier(maxIter=20, seed=42, **common),
    }[kind]
    out = None
    for f in range(n):
        model = make().fit(data.where(F.col("fold") != f))
        part = model.transform(data.where(F.col("fold") == f)).select("sample_idx", "y", vector_to_array("probability")[1].alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


