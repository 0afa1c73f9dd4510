"""Exact order statistics and running sums over keys that may hold any share of the rows.

A window over a whole key would put it into one task. Here each key is cut into ranges of
values at approximate quantiles; windows run within ranges, and the ranges' totals, a few
dozen rows a key, are added in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored

#: Ranges that a key is cut into.
RANGES = 64


def _with_range(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    cuts = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    splits = df.groupBy(*keys).agg(F.percentile_approx(order, cuts, 1000).alias("_splits"))
    return df.join(splits, keys).withColumn("_range", F.size(F.filter("_splits", lambda s: s < F.col(order)))).drop("_splits")


def running_sums(df: DataFrame, keys: list[str], order: str, values: list[str], ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``below_<value>``: per row the sum of ``value`` over rows of the key with a lower ``order``.

    ``order`` must not be null, and with the columns ``ties`` behind it unique within a key
    (or aggregate ties first). The rows are stored first, as ranges, totals and sums each read
    them.
    """
    df = _with_range(stored(df), keys, order)
    inside = Window.partitionBy(*keys, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    totals = totals.select(*keys, "_range", *[F.coalesce(F.sum(f"_t_{v}").over(above), F.lit(0)).alias(f"_o_{v}") for v in values])
    out = df.withColumns({f"_l_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}).join(totals, [*keys, "_range"])
    return out.withColumns({f"below_{v}": F.col(f"_l_{v}") + F.col(f"_o_{v}") for v in values}).drop("_range", *[f"_{x}_{v}" for v in values for x in "lo"])


def tie_groups(df: DataFrame, keys: list[str], order: str, **sums: Column) -> DataFrame:
    """One row per key and value with its number of rows ``n`` and further sums, and what lies below each."""
    groups = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(name) for name, c in sums.items()])
    return running_sums(groups, keys, order, ["n", *sums])


def quantiles(df: DataFrame, keys: list[str], value: str, levels: list[float]) -> DataFrame:
    """(keys, level, q): exact quantiles with linear interpolation between order statistics."""
    groups = stored(tie_groups(df, keys, value))
    total = groups.groupBy(*keys).agg(F.sum("n").alias("_all"))
    wanted = total.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels]))).withColumn("_at", F.col("level") * (F.col("_all") - 1))
    near = groups.join(wanted, keys).where((F.col("below_n") <= F.ceil("_at")) & (F.col("below_n") + F.col("n") > F.floor("_at")))
    low = F.max(F.when(F.col("below_n") <= F.floor("_at"), F.col(value)))
    high = F.max(F.when(F.col("below_n") <= F.ceil("_at"), F.col(value)))
    return near.groupBy(*keys, "level").agg((low + (high - low) * F.max(F.col("_at") - F.floor("_at"))).alias("q"))


def descending_statistic(df: DataFrame, keys: list[str], value: str, position: Column) -> DataFrame:
    """(keys, q): the value at a zero-based place in descending order; ``position`` may use the key's row count ``_all``.

    Beyond the last place, the least value less 1e-9.
    """
    groups = stored(tie_groups(df, keys, value))
    total = groups.groupBy(*keys).agg(F.sum("n").alias("_all"), F.min(value).alias("_least"))
    at = total.withColumn("_at", position)
    hit = groups.join(at, keys).where((F.col("_all") - F.col("below_n") > F.col("_at")) & (F.col("_all") - F.col("below_n") - F.col("n") <= F.col("_at")))
    found = hit.select(*keys, F.col(value).alias("_q"))
    return at.join(found, keys, "left").select(*keys, F.coalesce("_q", F.col("_least") - 1e-9).alias("q"))
