"""Detector combinations: budgeted accumulation, votes, comparisons, cascades and orders.

A case is an ordered list of methods: rows (case, step, method), step from 0. Its first
method works at a false-positive rate, the others add only what no background sample
reaches. Cases and methods are few and are broadcast; samples stay distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .ensemble import unit_span
from .evaluation import fpr_thresholds, method_summary, order_statistic_threshold, share


def case_orders(summary: DataFrame, max_methods: int = 6) -> DataFrame:
    """Orders by AUC, and by the anomaly share at 1 % with AUC; of equal orders the first stays."""
    auc = Window.orderBy(F.desc("auc"), "method")  # a row per method
    rate = Window.orderBy(F.desc("tpr_1"), F.desc("auc"), "method")
    ranked = summary.select("method", (F.row_number().over(auc) - 1).alias("_a"), (F.row_number().over(rate) - 1).alias("_r"))
    made = ranked.select(F.lit(0).alias("_pos"), F.lit("top AUC").alias("case"), F.col("_a").alias("step"), "method").unionByName(ranked.select(F.lit(1).alias("_pos"), F.lit("top rate at 1 %").alias("case"), F.col("_r").alias("step"), "method")).where(F.col("step") < max_methods)
    keys = made.groupBy("_pos", "case").agg(F.concat_ws(">", F.transform(F.sort_array(F.collect_list(F.struct("step", "method"))), lambda x: x["method"])).alias("_key"))
    first = keys.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_pos"))).where("_n = 1").select("case")
    return made.join(F.broadcast(first), "case", "left_semi").select("case", "step", "method")


def case_hits(bank: DataFrame, orders: DataFrame, first_fpr: float = 0.01) -> DataFrame:
    """(case, step, method, sample_idx, label, y): what each step detects, strictly above its threshold."""
    first = fpr_thresholds(bank, [first_fpr]).select("method", F.col("threshold").alias("_first"))
    top = bank.where("y = 0").groupBy("method").agg(F.max("score").alias("_top"))
    steps = orders.join(first, "method").join(top, "method").withColumn("_cut", F.when(F.col("step") == 0, F.col("_first")).otherwise(F.col("_top")))
    return bank.join(F.broadcast(steps), "method").where(F.col("score") > F.col("_cut")).select("case", "step", "method", "sample_idx", "label", "y")


def accumulation(bank: DataFrame, orders: DataFrame, first_fpr: float = 0.01) -> DataFrame:
    """Per case and step: hits on anomalies, those that no step before had, their running total, and background hits so far."""
    hits = case_hits(bank, orders, first_fpr)
    first_seen = Window.partitionBy("case", "sample_idx")
    marked = hits.withColumn("_new", (F.min("step").over(first_seen) == F.col("step")).cast("long"))
    per = marked.groupBy("case", "step").agg(F.sum("y").alias("hits"), F.sum(F.col("y") * F.col("_new")).alias("new_hits"), F.sum((1 - F.col("y")) * F.col("_new")).alias("_fp"))
    upto = Window.partitionBy("case").orderBy("step")
    out = orders.join(per, ["case", "step"], "left").na.fill(0, ["hits", "new_hits", "_fp"])
    return out.select("case", "step", "method", "hits", "new_hits", F.sum("new_hits").over(upto).alias("recovered"), F.sum("_fp").over(upto).alias("union_fp"))


def detector_votes(bank: DataFrame, orders: DataFrame, first_fpr: float = 0.01) -> DataFrame:
    """Per case and recovered anomaly: its votes and the methods that found it, in order."""
    found = case_hits(bank, orders, first_fpr).where("y = 1")
    listed = F.sort_array(F.collect_list(F.struct("step", "method")))
    agg = found.groupBy("case", "sample_idx", "label").agg(F.count(F.lit(1)).alias("votes"), listed.alias("_l"))
    return agg.select("case", "sample_idx", "label", "votes", F.array_join(F.transform("_l", lambda x: x["method"]), ", ").alias("methods"))


def case_scores(bank: DataFrame, orders: DataFrame, first_fpr: float = 0.01) -> DataFrame:
    """Per case and sample: votes over all its methods, and the mean of their scores scaled to 0..1."""
    votes = case_hits(bank, orders, first_fpr).groupBy("case", "sample_idx").agg(F.count(F.lit(1)).alias("votes"))
    soft = unit_span(bank).join(F.broadcast(orders), "method").groupBy("case", "sample_idx").agg(F.avg("unit").alias("soft_score"))
    return soft.join(votes, ["case", "sample_idx"], "left").select("case", "sample_idx", F.coalesce("votes", F.lit(0)).alias("votes"), "soft_score")


def compare_cases(bank: DataFrame, orders: DataFrame, first_fpr: float = 0.01) -> DataFrame:
    """One row per case with its methods, recovered anomalies, coverage and background hits, best first."""
    total = bank.where("y = 1").agg(F.count_distinct("sample_idx").alias("total"))
    steps = accumulation(bank, orders, first_fpr)
    listed = F.sort_array(F.collect_list(F.struct("step", "method")))
    agg = steps.groupBy("case").agg(F.array_join(F.transform(listed, lambda x: x["method"]), " -> ").alias("methods"), F.count(F.lit(1)).alias("n_methods"), F.max("recovered").alias("recovered"), F.max("union_fp").alias("union_fp"))
    out = agg.crossJoin(F.broadcast(total)).withColumn("coverage", share(F.col("recovered"), F.col("total")))
    return out.select("case", "methods", "n_methods", "recovered", "total", "coverage", "union_fp").orderBy(F.desc("coverage"), F.desc("recovered"), "union_fp", "n_methods", "case")


def detection_matrix(votes: DataFrame, methods: list[str]) -> DataFrame:
    """Per recovered sample, a 0/1 column for each of the named methods; names not asked for are left out."""
    cells = votes.select("case", "sample_idx", F.explode(F.transform(F.split(F.coalesce("methods", F.lit("")), ","), lambda m: F.trim(m))).alias("method")).where("method <> ''")
    return cells.groupBy("case", "sample_idx").agg(*[F.max((F.col("method") == m).cast("int")).alias(m) for m in methods])


def cascade(bank: DataFrame, order: list[str], far: float = 0.01) -> DataFrame:
    """Greedy cascade: each method flags at the budget that is left over the background not flagged so far.

    Threshold of a step: the (remaining)-th greatest score of unflagged background; flags
    reach it (inclusive), so ties may exceed the budget. Without budget a step is skipped and
    has no threshold. One aggregate per step; methods are few.
    """
    wide = bank.groupBy("sample_idx", "y").agg(*[F.max(F.when(F.col("method") == m, F.col("score"))).alias(f"s_{i}") for i, m in enumerate(order)])
    budget = int(far * bank.where("y = 0").select("sample_idx").distinct().count())
    flagged, rows, used = F.lit(False), [], 0
    for i, method in enumerate(order):
        left = budget - used
        if left <= 0:
            rows.append((i, method, None, 0, 0))
            continue
        score = F.col(f"s_{i}")
        best = wide.where((F.col("y") == 0) & ~flagged).orderBy(score.desc()).limit(left).agg(F.min(score).alias("t")).first()["t"]
        if best is None:
            rows.append((i, method, None, 0, 0))
            continue
        hit = ~flagged & (score >= F.lit(best))
        got = wide.where(hit).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("a"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("b")).first()
        flagged, used = flagged | (score >= F.lit(best)), used + got["b"]
        rows.append((i, method, float(best), int(got["a"]), int(got["b"])))
    return bank.sparkSession.createDataFrame(rows, "step int, method string, threshold double, new_anomalies long, new_background long")


def cascade_order(bank: DataFrame, far: float = 0.01) -> list[str]:
    """Methods by the anomalies each finds alone at the budget (see ``order_statistic_threshold``), most first, ties by name; a row a method comes back."""
    alone = order_statistic_threshold(bank, far).select("method", "n_detected")
    return [r["method"] for r in alone.orderBy(F.desc("n_detected"), "method").collect()]


def cascade_report(bank: DataFrame, far: float = 0.01, order: list[str] | None = None) -> DataFrame:
    """The cascade with what is found and flagged up to each step, its rates, and whether the step was skipped for want of budget.

    Without ``order``, methods come by what each finds alone. Shares of no anomalies or no
    background are 0.
    """
    totals = bank.groupBy("sample_idx").agg(F.max("y").alias("y")).agg(F.coalesce(F.sum("y"), F.lit(0)).alias("p_all"), F.coalesce(F.sum(1 - F.col("y")), F.lit(0)).alias("n_all"))
    steps = cascade(bank, cascade_order(bank, far) if order is None else order, far)
    so_far = Window.orderBy("step")  # a row a method
    out = steps.crossJoin(F.broadcast(totals)).withColumns({"cum_anomalies": F.sum("new_anomalies").over(so_far), "cum_background": F.sum("new_background").over(so_far)})
    return out.select("step", "method", "threshold", "new_anomalies", "new_background", "cum_anomalies", "cum_background", share(F.col("cum_anomalies"), F.col("p_all")).alias("tpr"), share(F.col("cum_background"), F.col("n_all")).alias("far"), F.col("threshold").isNull().alias("skipped")).orderBy("step")


def greedy_order(bank: DataFrame, ranking: list[str], start: list[str] | None = None, max_methods: int = 6, first_fpr: float = 0.01) -> list[str]:
    """Methods by what they add above the background's greatest score: most new hits, then most hits, then ``ranking``.

    The first method of ``start`` works at ``first_fpr``, as in a case, and what it finds
    there isn't new to others. The hits are those of few methods on anomalies; per round one
    aggregate counts them. Only labelled rows can tell, so such an order is no fair choice.
    """
    order = list(start or [])
    top = bank.where("y = 0").groupBy("method").agg(F.max("score").alias("_top"))
    if order:
        own = fpr_thresholds(bank.where(F.col("method") == order[0]), [first_fpr]).select("method", F.col("threshold").alias("_own"))
        top = top.join(F.broadcast(own), "method", "left").select("method", "_top", F.coalesce("_own", "_top").alias("_cut"))
    else:
        top = top.withColumn("_cut", F.col("_top"))
    hits = bank.where("y = 1").join(F.broadcast(top), "method").where(F.col("score") > F.least("_top", "_cut"))
    apart = lambda reached: F.collect_set(F.when(reached, F.col("method")))
    found = stored(hits.groupBy("sample_idx").agg(apart(F.col("score") > F.col("_top")).alias("by"), apart(F.col("score") > F.col("_cut")).alias("seen_by")))
    while len(order) < max_methods:
        seen = F.arrays_overlap("seen_by", F.array(*[F.lit(m) for m in order])) if order else F.lit(False)
        left = found.select(F.explode("by").alias("method"), (~seen).cast("int").alias("new")).groupBy("method").agg(F.sum("new").alias("new"), F.count(F.lit(1)).alias("all")).collect()
        choice = [(-r["new"], -r["all"], ranking.index(r["method"]), r["method"]) for r in left if r["method"] in ranking and r["method"] not in order and r["new"] > 0]
        if not choice:
            return order
        order.append(min(choice)[3])
    return order


@dataclass
class CaseAnalysis:
    """Orders (case, step, method) with their accumulation, comparison (best first) and votes (most first)."""

    orders: DataFrame
    steps: DataFrame
    comparison: DataFrame
    votes: DataFrame


def default_case_analysis(bank: DataFrame, summary: DataFrame | None = None, max_methods: int = 6, first_fpr: float = 0.01, oracle: bool = False) -> CaseAnalysis:
    """The usual orders of a bank's methods, compared under the same budget.

    Orders are by AUC and by the rate at 1 %; with ``oracle`` also greedy ones after the first
    of each. Equal orders count once. Without a summary of methods one is made.
    """
    summary = stored(method_summary(bank) if summary is None else summary)
    orders = case_orders(summary, max_methods)
    if oracle:
        ranks = [[r["method"] for r in summary.orderBy(*keys).select("method").collect()] for keys in ((F.desc("auc"), "method"), (F.desc("tpr_1"), F.desc("auc"), "method"))]  # a row a method
        known = {tuple(r["l"]) for r in orders.groupBy("case").agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "method"))), lambda x: x["method"]).alias("l")).collect()}
        rows = []
        for rank in ranks:
            made = greedy_order(bank, rank, rank[:1], max_methods, first_fpr) if rank else []
            if made and tuple(made) not in known:
                known.add(tuple(made))
                rows += [(f"greedy after {rank[0]}", step, method) for step, method in enumerate(made)]
        orders = orders.unionByName(bank.sparkSession.createDataFrame(rows, "case string, step int, method string"))
    orders = stored(orders)
    votes = detector_votes(bank, orders, first_fpr).orderBy("case", F.desc("votes"), "sample_idx")
    return CaseAnalysis(orders, accumulation(bank, orders, first_fpr).orderBy("case", "step"), compare_cases(bank, orders, first_fpr), votes)


def render_case(steps: DataFrame, total: int) -> str:
    """A case's accumulation as text, a line per step."""
    lines = [f"{r['step']}: {r['method']}: +{r['new_hits']} ({r['recovered']}/{total}), background {r['union_fp']}" for r in steps.orderBy("case", "step").collect()]
    return "\n".join(lines)
