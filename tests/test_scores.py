"""Known values of thresholds, rankings, ensembles and detector combinations on five samples and two methods."""

import numpy as np
import pytest

from sparkburst.operators import probes
from sparkburst.operators import cases, ensemble, evaluation
from sparkburst.operators.ordered import descending_statistic, quantiles

LABELS = [0, 0, 0, 1, 2]
SCORES = {"A": [0.10, 0.20, 0.30, 0.95, 0.99], "B": [0.05, 0.10, 0.11, 0.20, 0.90]}


@pytest.fixture(scope="module")
def bank(spark):
    rows = [(i, LABELS[i], int(LABELS[i] > 0), m, s) for m, v in SCORES.items() for i, s in enumerate(v)]
    return spark.createDataFrame(rows, "sample_idx long, label int, y int, method string, score double").cache()


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_thresholds(bank):
    at = as_dict(evaluation.rates_at_fpr(bank, [0.01]), "method")
    assert at["A"]["threshold"] == pytest.approx(0.298) and at["A"]["n_detected"] == 2 and at["A"]["n_false"] == 1
    assert at["B"]["threshold"] == pytest.approx(0.1098)
    zero = as_dict(evaluation.zero_fp(bank), "method")
    assert zero["A"]["threshold"] == 0.30 and zero["A"]["n_detected"] == 2


def test_auc_and_ap_against_brute_force(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 8
    rows = [(i, int(y[i]), int(y[i]), "m", float(s[i])) for i in range(300)]
    bank = spark.createDataFrame(rows, "sample_idx long, label int, y int, method string, score double")
    p, n = s[y == 1], s[y == 0]
    want = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert evaluation.roc_auc(bank).first()["auc"] == pytest.approx(want)
    order = sorted(set(s), reverse=True)
    recall = [0.0, *[(p >= t).sum() / len(p) for t in order]]
    precision = [(p >= t).sum() / (s >= t).sum() for t in order]
    ap = sum((b - a) * q for a, b, q in zip(recall, recall[1:], precision))
    assert evaluation.average_precision(bank).first()["ap"] == pytest.approx(ap)
    got = {round(r["level"], 3): r["q"] for r in quantiles(bank, ["method"], "score", [0.01, 0.5, 0.975]).collect()}
    assert all(got[q] == pytest.approx(np.percentile(s, 100 * q)) for q in got) and len(got) == 3
    from pyspark.sql import functions as F

    assert descending_statistic(bank, ["method"], "score", F.lit(7)).first()["q"] == np.sort(s)[::-1][7]


def test_one_class_only(spark):
    bank = spark.createDataFrame([(0, 0, 0, "m", 1.0), (1, 0, 0, "m", 2.0)], "sample_idx long, label int, y int, method string, score double")
    assert evaluation.roc_auc(bank).first()["auc"] == 0.5
    assert evaluation.average_precision(bank).first()["ap"] == 0.0
    empty = bank.limit(0)
    assert evaluation.rates_at_fpr(empty).count() == 0 and ensemble.rank_ensemble(empty).count() == 0


def test_leave_one_out_against_brute_force(bank):
    want = {}
    for i in range(5):
        total, weights = [], []
        for v in SCORES.values():
            o = [x for j, x in enumerate(v) if j != i]
            l = [LABELS[j] > 0 for j in range(5) if j != i]
            p, n = [x for x, a in zip(o, l) if a], [x for x, a in zip(o, l) if not a]
            auc = np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n])
            total.append((v[i] - min(o)) / (max(o) - min(o) + 1e-10))
            weights.append(max(auc - 0.5, 0))
        want[i] = np.dot(total, weights) / sum(weights)
    got = as_dict(ensemble.weighted_ensemble_loo(bank), "sample_idx")
    assert all(got[i]["ensemble"] == pytest.approx(want[i]) for i in want)
    plain, loo = as_dict(ensemble.rank_ensemble(bank), "sample_idx"), as_dict(ensemble.rank_ensemble_loo(bank), "sample_idx")
    assert all(loo[i]["ensemble"] == pytest.approx(plain[i]["ensemble"] / 5) for i in range(5))
    assert sum(r["n"] for r in ensemble.selection_counts(bank, 2).collect()) == 10


def test_cases(spark, bank):
    orders = spark.createDataFrame([("c", 0, "A"), ("c", 1, "B")], "case string, step int, method string")
    steps = as_dict(cases.accumulation(bank, orders), "step")
    assert steps[1]["recovered"] == 2 and steps[1]["union_fp"] == 1
    scores = as_dict(cases.case_scores(bank, orders), "sample_idx")
    assert [scores[i]["votes"] for i in range(5)] == [0, 0, 1, 2, 2]
    assert [round(scores[i]["soft_score"], 6) for i in range(5)] == [0, 0.085592, 0.147654, 0.565763, 1]
    assert cases.greedy_order(bank, ["A", "B"]) == ["A"]
    votes = cases.detector_votes(bank, orders)
    assert {r["sample_idx"]: (r["A"], r["B"]) for r in cases.detection_matrix(votes, ["A", "B"]).collect()} == {3: (1, 1), 4: (1, 1)}
    made = cases.case_orders(evaluation.method_summary(bank))
    assert {r["case"] for r in made.collect()} == {"top AUC"}


def test_greedy_order_counts_what_its_start_finds(spark):
    """A at 50 % already finds 4 and 5; B adds 6 and 7 above all background, C only 4 and 5."""
    scores = {"A": [0, 1, 2, 9, 8, 7, 0, 0], "B": [0, 0, 0, 0, 0, 0, 5, 6], "C": [0, 0, 0, 0, 3, 3, 0, 3]}
    rows = [(i, int(i > 3), int(i > 3), m, float(x)) for m, v in scores.items() for i, x in enumerate(v)]
    bank = spark.createDataFrame(rows, "sample_idx long, label int, y int, method string, score double")
    assert cases.greedy_order(bank, ["A", "B", "C"]) == ["C", "B"]
    assert cases.greedy_order(bank, ["A", "B", "C"], ["A"], first_fpr=0.5) == ["A", "B"]
    assert cases.greedy_order(bank, ["C", "B"], ["A"], first_fpr=0.01, max_methods=2) == ["A", "C"]
    assert cases.greedy_order(bank.where("y = 0"), ["A", "B"], ["A"]) == ["A"]


def test_default_case_analysis(bank):
    made = cases.default_case_analysis(bank, oracle=True)
    assert {r["case"] for r in made.orders.collect()} == {"top AUC", "greedy after A"}
    assert [(r["case"], r["recovered"]) for r in made.comparison.collect()] == [("greedy after A", 2), ("top AUC", 2)]
    assert [(r["case"], r["step"]) for r in made.steps.collect()] == [("greedy after A", 0), ("top AUC", 0), ("top AUC", 1)]
    assert [(r["case"], r["sample_idx"], r["votes"]) for r in made.votes.collect()] == [("greedy after A", 3, 1), ("greedy after A", 4, 1), ("top AUC", 3, 2), ("top AUC", 4, 2)]


def test_same_result_for_any_partitioning(bank):
    found = [sorted(map(tuple, evaluation.method_summary(bank.repartition(n)).collect())) for n in (1, 4, 17)]
    assert found[0] == found[1] == found[2]


def test_folds_are_stratified_and_few_rows_give_one_half(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(i % 9 == 0), [float(v) for v in rng.normal(size=2) + (i % 9 == 0)]) for i in range(90)]
    df = spark.createDataFrame(rows, "sample_idx long, y int, x array<double>").repartition(3)
    per = {(r["y"], r["fold"]): r["count"] for r in probes.folds(df, 5).groupBy("y", "fold").count().collect()}
    assert per == {(y, f): n for y, n in ((0, 16), (1, 2)) for f in range(5)}
    few = df.where("y = 0 or sample_idx = 0")
    assert {r["score"] for r in probes.out_of_fold(few).collect()} == {0.5}
    scored = probes.out_of_fold(df).collect()
    assert len(scored) == 90 and np.mean([r["score"] for r in scored if r["y"]]) > np.mean([r["score"] for r in scored if not r["y"]])
