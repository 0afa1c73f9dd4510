"""Ensembles of a score bank, with leave-one-out forms in closed form, and calibration.

Methods are few; samples are many. Everything per method is a small table that is
broadcast; everything per sample stays distributed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .evaluation import class_counts, order_statistic_threshold, roc_auc, score_groups
from .ordered import tie_groups

TINY = 1e-10


def minmax(bank: DataFrame) -> DataFrame:
    """Scores scaled by their method's span plus 1e-10."""
    span = bank.groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return bank.join(F.broadcast(span), "method").withColumn("scaled", (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo") + TINY)).drop("lo", "hi")


def unit_span(bank: DataFrame) -> DataFrame:
    """Scores scaled to 0..1; a method without span gives zeros."""
    span = bank.groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return bank.join(F.broadcast(span), "method").withColumn("unit", scaled).drop("lo", "hi")


def mid_ranks(bank: DataFrame) -> DataFrame:
    """Scores with their average rank within the method, from 1."""
    groups = tie_groups(bank, ["method"], "score")
    return bank.join(groups.select("method", "score", (F.col("below_n") + (F.col("n") + 1) / 2).alias("rank")), ["method", "score"])


def _mean(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy("sample_idx").agg(F.avg(column).alias("ensemble"))


def rank_ensemble(bank: DataFrame) -> DataFrame:
    """Mean of a sample's average ranks over methods."""
    return _mean(mid_ranks(bank), "rank")


def rank_ensemble_loo(bank: DataFrame) -> DataFrame:
    """Rank of each sample among the others and itself, over n: the rank ensemble over n."""
    n = bank.groupBy("method").agg(F.count(F.lit(1)).alias("_n"))
    ranked = mid_ranks(bank).join(F.broadcast(n), "method")
    return _mean(ranked.withColumn("rank", F.col("rank") / F.col("_n")), "rank")


def mean_ensemble(bank: DataFrame) -> DataFrame:
    return _mean(minmax(bank), "scaled")


def others_span(bank: DataFrame) -> DataFrame:
    """Per row the least and greatest score of the method's other rows, from its two least and two greatest groups."""
    low = bank.groupBy("method").agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    joined = bank.join(F.broadcast(low), "method")
    more = joined.groupBy("method").agg(
        F.sum((F.col("score") == F.col("_lo")).cast("long")).alias("_nlo"), F.sum((F.col("score") == F.col("_hi")).cast("long")).alias("_nhi"),
        F.min(F.when(F.col("score") > F.col("_lo"), F.col("score"))).alias("_lo2"), F.max(F.when(F.col("score") < F.col("_hi"), F.col("score"))).alias("_hi2"),
    )
    out = joined.join(F.broadcast(more), "method")
    least = F.when((F.col("score") == F.col("_lo")) & (F.col("_nlo") == 1), F.coalesce("_lo2", "_lo")).otherwise(F.col("_lo"))
    most = F.when((F.col("score") == F.col("_hi")) & (F.col("_nhi") == 1), F.coalesce("_hi2", "_hi")).otherwise(F.col("_hi"))
    return out.withColumn("lo_other", least).withColumn("hi_other", most).drop("_lo", "_hi", "_nlo", "_nhi", "_lo2", "_hi2")


def scaled_loo(bank: DataFrame) -> DataFrame:
    """Scores scaled by the span of the method's other samples; may leave 0..1."""
    return others_span(bank).withColumn("scaled", (F.col("score") - F.col("lo_other")) / (F.col("hi_other") - F.col("lo_other") + TINY))


def mean_ensemble_loo(bank: DataFrame) -> DataFrame:
    return _mean(scaled_loo(bank), "scaled")


def weighted_ensemble(bank: DataFrame) -> DataFrame:
    """Scaled scores weighted by each method's AUC over the sum of AUCs."""
    auc = roc_auc(bank)
    weights = auc.crossJoin(F.broadcast(auc.agg(F.sum("auc").alias("_sum")))).select("method", (F.col("auc") / F.col("_sum")).alias("w"))
    return minmax(bank).join(F.broadcast(weights), "method").groupBy("sample_idx").agg(F.sum(F.col("scaled") * F.col("w")).alias("ensemble"))


def top_methods(bank: DataFrame, k: int) -> DataFrame:
    """The ``k`` methods with the greatest AUC, ties by name."""
    return roc_auc(bank).orderBy(F.desc("auc"), "method").limit(k).select("method")


def topk_ensemble(bank: DataFrame, k: int = 2) -> DataFrame:
    """Mean ensemble of the ``k`` best methods."""
    return _mean(minmax(bank).join(F.broadcast(top_methods(bank, k)), "method", "left_semi"), "scaled")


def auc_without(bank: DataFrame) -> DataFrame:
    """Rows with ``auc_loo``: their method's AUC without them, from the pairs that each takes part in."""
    g = stored(score_groups(bank))
    neg_below, neg_here = F.col("below_n") - F.col("below_p"), F.col("n") - F.col("p")
    total = g.groupBy("method").agg(F.sum(F.col("p") * (neg_below + neg_here / 2)).alias("_u"))
    pos_above = F.col("p_all") - F.col("below_p") - F.col("p")
    sides = g.select("method", "score", (neg_below + neg_here / 2).alias("_as_pos"), (pos_above + F.col("p") / 2).alias("_as_neg"))
    rows = bank.join(sides, ["method", "score"]).join(F.broadcast(total), "method").join(F.broadcast(class_counts(bank)), "method")
    own = F.when(F.col("y") == 1, F.col("_as_pos")).otherwise(F.col("_as_neg"))
    pairs = (F.col("p_all") - F.col("y")) * (F.col("n_all") - (1 - F.col("y")))
    return rows.withColumn("auc_loo", F.when(pairs > 0, (F.col("_u") - own) / pairs).otherwise(0.5)).drop("_as_pos", "_as_neg", "_u", "p_all", "n_all")


def weighted_ensemble_loo(bank: DataFrame) -> DataFrame:
    """Weights max(AUC without the sample - 0.5, 0), uniform if they vanish; scaled by the other samples."""
    rows = scaled_loo(stored(auc_without(bank))).withColumn("w", F.greatest(F.col("auc_loo") - 0.5, F.lit(0.0)))
    agg = rows.groupBy("sample_idx").agg(F.sum("w").alias("_w"), F.sum(F.col("scaled") * F.col("w")).alias("_s"), F.avg("scaled").alias("_m"))
    return agg.select("sample_idx", F.when(F.col("_w") < TINY, F.col("_m")).otherwise(F.col("_s") / F.col("_w")).alias("ensemble"))


def loo_picks(bank: DataFrame, k: int = 2) -> DataFrame:
    """Per sample its ``k`` methods with the greatest AUC without it, ties by name."""
    best = Window.partitionBy("sample_idx").orderBy(F.desc(F.round("auc_loo", 12)), "method")
    return scaled_loo(stored(auc_without(bank))).withColumn("pick", F.row_number().over(best)).where(F.col("pick") <= k)


def topk_ensemble_loo(bank: DataFrame, k: int = 2) -> DataFrame:
    return _mean(loo_picks(bank, k), "scaled")


def selection_counts(bank: DataFrame, k: int = 2) -> DataFrame:
    """How often leave-one-out picks each method."""
    return loo_picks(bank, k).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def ecdf_normalise(calibration: DataFrame, query: DataFrame) -> DataFrame:
    """Share of calibration scores strictly below each query score, per method; 0 without calibration."""
    size = calibration.groupBy("method").agg(F.count(F.lit(1)).alias("_m"))
    both = calibration.select("method", "score", F.lit(1).alias("c")).unionByName(query.select("method", "score", F.lit(0).alias("c")))
    below = tie_groups(both, ["method"], "score", c=F.col("c")).select("method", "score", F.col("below_c").alias("_below"))
    rows = query.join(below, ["method", "score"]).join(F.broadcast(size), "method", "left")
    return rows.withColumn("ecdf", F.col("_below") / F.greatest(F.coalesce("_m", F.lit(0)), F.lit(1))).drop("_below", "_m")


def weighted_score(rows: DataFrame, weights: dict[str, float], column: str = "score") -> DataFrame:
    """Sum over methods of weight times score; methods without a weight don't count."""
    w = rows.sparkSession.createDataFrame(list(weights.items()), "method string, w double")
    return rows.join(F.broadcast(w), "method").groupBy("sample_idx").agg(F.sum(F.col(column) * F.col("w")).alias("ensemble"))


def blend_scores(columns: list[Column], weights: list[float] | None = None) -> Column:
    """Weighted mean of score columns; weights are divided by their sum, and are equal by default."""
    if not columns:
        raise ValueError("nothing to blend")
    weights = weights or [1.0] * len(columns)
    return sum((c * w for c, w in zip(columns[1:], weights[1:])), columns[0] * weights[0]) / sum(weights)


def reconstruction_gate(a: Column, b: Column) -> Column:
    """Geometric mean of two scores: high only where both are."""
    return F.sqrt(a * b)


def default_ensembles(bank: DataFrame, topk: tuple[int, ...] = (2, 3), strict: bool = True) -> DataFrame:
    """Rank, mean, weighted and top-k ensembles as methods of a score bank; k below 1 is skipped."""
    kinds = {"Ens-Rank": rank_ensemble_loo, "Ens-Mean": mean_ensemble_loo, "Ens-Weighted": weighted_ensemble_loo} if strict else {"Ens-Rank": rank_ensemble, "Ens-Mean": mean_ensemble, "Ens-Weighted": weighted_ensemble}
    made = [f(bank).withColumn("method", F.lit(name)) for name, f in kinds.items()]
    made += [(topk_ensemble_loo if strict else topk_ensemble)(bank, k).withColumn("method", F.lit(f"Ens-Top{k}")) for k in topk if k >= 1]
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out.select("sample_idx", "method", F.col("ensemble").alias("score"))


def weight_objective(rows: DataFrame, weights: dict[str, float], far: float = 0.01, entropy: float = 0.08) -> DataFrame:
    """The share of anomalies at the background's order-statistic threshold, and that plus ``entropy`` times the weights' normalised entropy."""
    combined = weighted_score(rows, weights).join(rows.select("sample_idx", "y").distinct(), "sample_idx").select("sample_idx", "y", F.lit("weights").alias("method"), F.round("ensemble", 9).alias("score"))
    found = order_statistic_threshold(combined, far).join(class_counts(combined), "method")
    total = sum(weights.values())
    spread = -sum(w / total * math.log(w / total) for w in weights.values() if w > 0) / (math.log(len(weights)) if len(weights) > 1 else 1)
    tpr = F.when(F.col("p_all") > 0, F.col("n_detected") / F.col("p_all")).otherwise(0.0)
    return found.select(tpr.alias("tpr"), (tpr + entropy * spread).alias("objective"))
