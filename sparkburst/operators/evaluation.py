"""Thresholds, rates and ranking measures of a score bank, per method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stored import stored
from .ordered import descending_statistic, quantiles, tie_groups

FPRS = (0.01, 0.025, 0.05, 0.10)


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where there is no whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def fpr_thresholds(bank: DataFrame, fprs=FPRS) -> DataFrame:
    """(method, fpr, threshold): the interpolated quantile 1 - fpr of the background's scores."""
    cut = quantiles(bank.where("y = 0"), ["method"], "score", [1 - f for f in fprs])
    return cut.select("method", F.round(1 - F.col("level"), 6).alias("fpr"), F.col("q").alias("threshold"))


def rates_at_fpr(bank: DataFrame, fprs=FPRS) -> DataFrame:
    """Detections above (strictly) each threshold: anomalies, background, and the share of anomalies found."""
    over = bank.join(F.broadcast(fpr_thresholds(bank, fprs)), "method")
    hit = (F.col("score") > F.col("threshold")).cast("long")
    agg = over.groupBy("method", "fpr", "threshold").agg(F.sum(hit * F.col("y")).alias("n_detected"), F.sum("y").alias("n_total"), F.sum(hit * (1 - F.col("y"))).alias("n_false"))
    return agg.withColumn("tpr", share(F.col("n_detected"), F.col("n_total")))


def rates_by_class(bank: DataFrame, fpr: float = 0.01) -> DataFrame:
    """Share of each anomaly class above the background threshold."""
    over = bank.join(F.broadcast(fpr_thresholds(bank, [fpr])), "method").where("label > 0")
    hit = (F.col("score") > F.col("threshold")).cast("long")
    agg = over.groupBy("method", "label").agg(F.sum(hit).alias("n_detected"), F.count(F.lit(1)).alias("n_total"))
    return agg.withColumn("tpr", share(F.col("n_detected"), F.col("n_total")))


def zero_fp(bank: DataFrame) -> DataFrame:
    """Threshold at the background's greatest score, and what lies strictly above it."""
    top = bank.where("y = 0").groupBy("method").agg(F.max("score").alias("threshold"))
    over = bank.join(F.broadcast(top), "method")
    return over.groupBy("method", "threshold").agg(F.sum(((F.col("score") > F.col("threshold")) & (F.col("y") == 1)).cast("long")).alias("n_detected"), F.sum("y").alias("n_total"))


def hits_at_fpr(bank: DataFrame, fpr: float = 0.01) -> DataFrame:
    """True and false detections of each method at a false-positive rate."""
    return rates_at_fpr(bank, [fpr]).select("method", F.col("n_detected").alias("true_hits"), F.col("n_false").alias("false_hits"))


def order_statistic_threshold(bank: DataFrame, far: float = 0.01, strict_budget: bool = False) -> DataFrame:
    """Threshold at place floor(far n) of the background's descending scores; detections reach it (inclusive).

    As the threshold itself counts, it admits one more than the budget; ``strict_budget``
    takes the place before and stays within it.
    """
    background = bank.where("y = 0")
    place = F.floor(F.col("_all") * far) - (1 if strict_budget else 0)
    cut = descending_statistic(background, ["method"], "score", F.greatest(place, F.lit(0))).withColumnRenamed("q", "threshold")
    over = bank.join(F.broadcast(cut), "method")
    hit = (F.col("score") >= F.col("threshold")).cast("long")
    return over.groupBy("method", "threshold").agg(F.sum(hit * F.col("y")).alias("n_detected"), F.sum(hit * (1 - F.col("y"))).alias("n_false"))


def class_counts(bank: DataFrame) -> DataFrame:
    return bank.groupBy("method").agg(F.sum("y").alias("p_all"), F.sum(1 - F.col("y")).alias("n_all"))


def score_groups(bank: DataFrame) -> DataFrame:
    """Distinct scores of each method with positives and rows there and below, and the method's totals."""
    return tie_groups(bank, ["method"], "score", p=F.col("y")).join(F.broadcast(class_counts(bank)), "method")


def roc_auc(bank: DataFrame) -> DataFrame:
    """(method, auc): the share of (anomaly, background) pairs in order, ties half; 0.5 with one class only."""
    g = score_groups(bank)
    ordered = F.sum(F.col("p") * ((F.col("below_n") - F.col("below_p")) + (F.col("n") - F.col("p")) / 2))
    pairs = F.first("p_all") * F.first("n_all")
    return g.groupBy("method").agg(F.when(pairs > 0, ordered / pairs).otherwise(0.5).alias("auc"))


def average_precision(bank: DataFrame) -> DataFrame:
    """(method, ap): precision at each distinct threshold, weighted by the recall it adds; 0 without anomalies."""
    g = score_groups(bank)
    reached = F.col("p_all") - F.col("below_p")
    shown = F.col("p_all") + F.col("n_all") - F.col("below_n")
    gain = F.when(F.col("p_all") > 0, F.col("p") / F.col("p_all") * reached / shown).otherwise(0.0)
    return g.groupBy("method").agg(F.sum(gain).alias("ap"))


def roc_points(bank: DataFrame) -> DataFrame:
    """Rates at each distinct score as an inclusive threshold."""
    g = score_groups(bank)
    tp = F.col("p_all") - F.col("below_p")
    fp = F.col("n_all") - (F.col("below_n") - F.col("below_p"))
    return g.select("method", F.col("score").alias("threshold"), share(tp, F.col("p_all")).alias("tpr"), share(fp, F.col("n_all")).alias("fpr"))


def method_summary(bank: DataFrame) -> DataFrame:
    """AUC, AP, and anomaly shares at 1 % and 5 %, per class at 1 %, of each method.

    All from one table of the distinct scores: thresholds lie between two of the
    background's, and rates are sums above them.
    """
    counts = {"p": F.col("y"), "c1": (F.col("label") == 1).cast("int"), "c2": (F.col("label") == 2).cast("int")}
    g = stored(tie_groups(bank, ["method"], "score", **counts))
    totals = g.groupBy("method").agg(F.sum(F.col("n") - F.col("p")).alias("n_all"), *[F.sum(c).alias(f"{c}_all") for c in counts])
    g = g.join(F.broadcast(totals), "method")  # a row a method
    below = F.col("below_n") - F.col("below_p")
    at = {name: (1 - fpr) * (F.col("n_all") - 1) for name, fpr in (("1", 0.01), ("5", 0.05))}
    ends = [f(F.when(below <= to(place), F.col("score"))).alias(f"_{side}{name}") for name, place in at.items() for side, f, to in (("lo", F.max, F.floor), ("hi", F.max, F.ceil))]
    shares = [F.first(place - F.floor(place)).alias(f"_part{name}") for name, place in at.items()]
    cuts = g.where("n > p").groupBy("method").agg(*ends, *shares)
    cuts = cuts.select("method", *[(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * F.col(f"_part{k}")).alias(f"_cut{k}") for k in at])
    g = g.join(F.broadcast(cuts), "method")
    pairs = F.first("p_all") * F.first("n_all")
    won = F.sum(F.col("p") * (below + (F.col("n") - F.col("p")) / 2))
    gain = F.when(F.col("p_all") > 0, F.col("p") / F.col("p_all") * (F.col("p_all") - F.col("below_p")) / (F.col("p_all") + F.col("n_all") - F.col("below_n"))).otherwise(0.0)
    found = lambda c, k: F.coalesce(F.sum(F.when(F.col("score") > F.col(f"_cut{k}"), F.col(c))), F.lit(0))
    of_class = lambda c: F.when(F.first(f"{c}_all") > 0, found(c, "1") / F.first(f"{c}_all"))
    return g.groupBy("method").agg(
        F.when(pairs > 0, won / pairs).otherwise(0.5).alias("auc"), F.sum(gain).alias("ap"),
        share(found("p", "1"), F.first("p_all")).alias("tpr_1"), share(found("p", "5"), F.first("p_all")).alias("tpr_5"),
        of_class("c1").alias("tpr_c1"), of_class("c2").alias("tpr_c2"),
    )


def rank_tests(features: DataFrame) -> DataFrame:
    """(feature, u, n1, n2, ties, effect, p_value) per feature of (feature, value, y).

    U counts pairs that an anomaly wins, ties half; ``ties`` sums t^3 - t over equal values; the
    effect is |1 - 2U/(n1 n2)|; p is the normal two-sided one with tie and continuity corrections.
    """
    bank = features.select(F.col("feature").alias("method"), F.col("value").alias("score"), "y")
    g = score_groups(bank)
    u = F.sum(F.col("p") * ((F.col("below_n") - F.col("below_p")) + (F.col("n") - F.col("p")) / 2))
    ties = F.sum(F.pow(F.col("n"), 3) - F.col("n"))
    out = g.groupBy("method").agg(u.alias("u"), ties.cast("double").alias("ties"), F.first("p_all").alias("n1"), F.first("n_all").alias("n2"))
    n = F.col("n1") + F.col("n2")
    spread = F.sqrt(F.col("n1") * F.col("n2") / 12 * ((n + 1) - F.col("ties") / F.greatest(n * (n - 1), F.lit(1))))
    z = F.when(spread > 0, F.greatest(F.abs(F.col("u") - F.col("n1") * F.col("n2") / 2) - 0.5, F.lit(0.0)) / spread).otherwise(0.0)
    pairs = F.col("n1") * F.col("n2")
    effect = F.when(pairs > 0, F.abs(1 - 2 * F.col("u") / pairs)).otherwise(0.0)
    return out.select(F.col("method").alias("feature"), "u", "n1", "n2", "ties", effect.alias("effect"), upper_tail(z).alias("p_value"))


def mann_whitney(features: DataFrame) -> DataFrame:
    """(feature, u, effect, p_value) with the normal p; see ``rank_tests``."""
    return rank_tests(features).select("feature", "u", "effect", "p_value")


def upper_tail(z: Column) -> Column:
    """The two-sided normal tail 2 (1 - Phi(z)) of z >= 0, by a series up to 3 and a continued fraction beyond."""
    step = lambda state, k: F.struct((state["t"] * z * z / (2 * k + 1)).alias("t"), (state["s"] + state["t"] * z * z / (2 * k + 1)).alias("s"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(z.alias("t"), z.alias("s")), step)
    density = F.exp(-z * z / 2) / 2.5066282746310002
    near = 1 - 2 * density * series["s"]
    fraction = F.aggregate(F.sequence(F.lit(40), F.lit(1), F.lit(-1)), z, lambda a, k: z + k / a)
    return F.when(z < 3, near).otherwise(2 * density / fraction)


def histogram(bank: DataFrame, bins: int = 20) -> DataFrame:
    """Counts in equal bins from each method's least to greatest score, split by class."""
    span = bank.groupBy("method").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return bank.join(F.broadcast(span), "method").groupBy("method", at.cast("int").alias("bin"), "y").agg(F.count(F.lit(1)).alias("n"))
