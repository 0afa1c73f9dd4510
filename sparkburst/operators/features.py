"""Physics-style features of spectrogram cells (id, m, k, p; both from 0), by aggregates per spectrogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation, 0 where a side is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.when(spread > 1e-12, spread)), F.lit(0.0))


def _moments(p: str = "p") -> list[Column]:
    wide = F.percentile(p, F.array(F.lit(0.05), F.lit(0.95)))
    constant = F.stddev_pop(p) < 1e-12
    return [
        F.avg(p).alias("mean"), F.stddev_pop(p).alias("std"),
        F.when(constant, 0.0).otherwise(F.coalesce(F.kurtosis(p), F.lit(0.0))).alias("kurtosis"), F.when(constant, 0.0).otherwise(F.coalesce(F.skewness(p), F.lit(0.0))).alias("skew"),
        (wide[1] - wide[0]).alias("range"),
    ]


def band_of(cells: DataFrame, n_bands: int = 8) -> DataFrame:
    """Add ``band``: rows split as evenly as can be, the first H mod n bands one row longer."""
    tall = cells.groupBy("id").agg((F.max("m") + 1).alias("_h"))
    base, more = F.floor(F.col("_h") / n_bands), F.col("_h") % n_bands
    in_long = F.col("m") < more * (base + 1)
    band = F.when(in_long, F.floor(F.col("m") / (base + 1))).otherwise(more + F.floor((F.col("m") - more * (base + 1)) / F.greatest(base, F.lit(1))))
    return cells.join(tall, "id").withColumn("band", band.cast("int")).drop("_h")


def band_moments(cells: DataFrame, n_bands: int = 8) -> DataFrame:
    """Mean, deviation, excess kurtosis, skew and 5 to 95 % range of each frequency band."""
    return band_of(cells, n_bands).groupBy("id", "band").agg(*_moments())


def global_moments(cells: DataFrame) -> DataFrame:
    wide = F.percentile("p", F.array(F.lit(0.01), F.lit(0.99)))
    return cells.groupBy("id").agg(*_moments()[:4], (wide[1] - wide[0]).alias("range"))


def frame_profile(cells: DataFrame) -> DataFrame:
    return cells.groupBy("id", "k").agg(F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"))


def temporal_features(cells: DataFrame) -> DataFrame:
    """Deviation of frame means and of their differences, mean absolute difference, linear trend, mean frame deviation."""
    prof = frame_profile(cells).withColumn("diff", F.col("mean") - F.lag("mean").over(Window.partitionBy("id").orderBy("k")))
    trend = F.coalesce(F.try_divide(F.covar_pop("k", "mean"), F.nullif(F.var_pop("k"), F.lit(0.0))), F.lit(0.0))
    return prof.groupBy("id").agg(F.stddev_pop("mean").alias("std_mean"), F.coalesce(F.stddev_pop("diff"), F.lit(0.0)).alias("std_diff"), F.coalesce(F.avg(F.abs("diff")), F.lit(0.0)).alias("abs_diff"), trend.alias("trend"), F.avg("std").alias("mean_std"))


def spectral_shape(cells: DataFrame) -> DataFrame:
    """Entropy, centroid and bandwidth of the frequency profile, the latter two over the height."""
    prof = cells.groupBy("id", "m").agg(F.avg("p").alias("a"))
    low = prof.groupBy("id").agg(F.min("a").alias("_lo"), F.sum("a").alias("_s"), F.count(F.lit(1)).alias("_h"))
    share = (F.col("a") - F.col("_lo")) / (F.col("_s") - F.col("_lo") * F.col("_h") + 1e-10)
    dist = prof.join(low, "id").withColumn("w", share)
    first = dist.groupBy("id", "_h").agg((-F.sum(F.col("w") * F.log(F.col("w") + 1e-10))).alias("entropy"), F.sum(F.col("w") * F.col("m")).alias("_c"), F.sum(F.col("w") * F.col("m") * F.col("m")).alias("_c2"), F.sum("w").alias("_w"))
    spread = F.sqrt(F.greatest(F.col("_c2") - 2 * F.col("_c") * F.col("_c") + F.col("_c") * F.col("_c") * F.col("_w"), F.lit(0.0)))
    return first.select("id", "entropy", (F.col("_c") / F.col("_h")).alias("centroid"), (spread / F.col("_h")).alias("bandwidth"))


def peak_track(cells: DataFrame) -> DataFrame:
    """Per spectrogram of the loudest bin of each frame (the lower on ties): mean, deviation, step deviation, mean step, over the height, and lag-1 correlation."""
    tall = cells.groupBy("id").agg((F.max("m") + 1).alias("h"))
    peaks = cells.groupBy("id", "k").agg(F.max_by("m", F.struct(F.col("p"), (-F.col("m")).alias("_o"))).cast("double").alias("peak"))
    steps = peaks.withColumn("before", F.lag("peak").over(Window.partitionBy("id").orderBy("k"))).join(tall, "id")
    agg = steps.groupBy("id", "h").agg(F.avg("peak").alias("a"), F.stddev_pop("peak").alias("b"), F.coalesce(F.stddev_pop(F.col("peak") - F.col("before")), F.lit(0.0)).alias("c"), F.coalesce(F.avg(F.abs(F.col("peak") - F.col("before"))), F.lit(0.0)).alias("d"), safe_corr(F.when(F.col("before").isNotNull(), F.col("peak")), F.col("before")).alias("lag1"))
    return agg.select("id", *[(F.col(c) / F.col("h")).alias(n) for c, n in zip("abcd", ("mean", "std", "step_std", "step_abs"))], "lag1")


def band_correlation(cells: DataFrame, n_bands: int = 8) -> DataFrame:
    """Mean, deviation, greatest and share over 0.7 of the correlations between bands' profiles over frames.

    At most n_bands (n_bands - 1) / 2 pairs a spectrogram.
    """
    prof = band_of(cells, n_bands).groupBy("id", "k", "band").agg(F.avg("p").alias("a"))
    wide = prof.groupBy("id", "k").agg(F.sort_array(F.collect_list(F.struct("band", "a"))).alias("v"))
    size = F.size("v")
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.slice("v", i + 1, size), lambda y: F.struct(F.element_at("v", i)["band"].alias("x"), y["band"].alias("y"), F.element_at("v", i)["a"].alias("a"), y["a"].alias("b")))))
    per = wide.where(size > 1).select("id", F.explode(pairs).alias("q")).groupBy("id", "q.x", "q.y").agg(safe_corr(F.col("q.a"), F.col("q.b")).alias("r"))
    return per.groupBy("id").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("std"), F.max("r").alias("most"), F.avg((F.col("r") > 0.7).cast("double")).alias("over"))


def row_coupling(cells: DataFrame, rows: int = 4) -> DataFrame:
    """Correlation over frames of two channels (id, m, k, p, q) at ``rows`` evenly spread frequencies; 0 where one is constant."""
    tall = cells.groupBy("id").agg(F.max("m").alias("_top"))
    at = cells.join(tall, "id").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).where(F.col("m") == F.floor(F.col("j") * F.col("_top") / (rows - 1)))
    return at.groupBy("id", "j").agg(safe_corr(F.col("p"), F.col("q")).alias("r"))
