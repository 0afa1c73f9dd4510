"""Bootstrap draws against resampled pairs, exact tails against all rank orders, cascades against a plain loop."""

import itertools
import math

import numpy as np
import pytest

from sparkburst.operators import cases, evaluation, resampling

SCHEMA = "sample_idx long, label int, y int, method string, score double"


def pairs_auc(p, n, s):
    over = (s[:, None] > s) + (s[:, None] == s) / 2
    return (p[:, None] * over * n).sum() / p.sum() / n.sum()


@pytest.fixture(scope="module")
def bank(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(1500) < 0.2).astype(int)
    scores = {"tied": np.where(rng.random(1500) < 0.5, 3.0, rng.integers(0, 9, 1500)), "fine": rng.normal(size=1500) + y, "one": np.full(1500, 2.0)}
    rows = [(i, int(y[i]), int(y[i]), m, float(s[i])) for m, s in scores.items() for i in range(1500)]
    return spark.createDataFrame(rows, SCHEMA).cache()


def test_draws_equal_weighted_pairs(spark, bank):
    draws = 10
    from pyspark.sql import functions as F

    rows = bank.withColumn("key", F.xxhash64(F.lit(42), "sample_idx")).toPandas()
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        got = {(r["method"], r["draw"]): r["auc"] for r in resampling.bootstrap_draws(bank, draws).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == 3 * draws
        for method, f in rows.groupby("method"):
            w, y = resampling.draw_weights(f["key"].to_numpy(), draws).astype(float), f["y"].to_numpy()
            for b in range(draws):
                assert got[method, b] == pytest.approx(pairs_auc(w[:, b] * y, w[:, b] * (1 - y), f["score"].to_numpy()), abs=1e-12)


def test_weights_are_poisson():
    w = resampling.draw_weights(np.arange(4000) * 7919, 1001)
    assert w.shape == (4000, 1001)
    for k in range(5):
        assert (w == k).mean() == pytest.approx(math.exp(-1) / math.factorial(k), abs=1e-3)
    assert abs(np.corrcoef(w[:, :8].T.astype(float))[np.triu_indices(8, 1)]).max() < 0.08


def test_intervals_and_report(spark, bank):
    rows = {r["method"]: r for r in resampling.bootstrap_auc(bank, 400).collect()}
    f = bank.where("method = 'fine'").toPandas()
    rng = np.random.default_rng(1)
    s, y = f["score"].to_numpy(), f["y"].to_numpy()
    plain = [pairs_auc(w * y, w * (1 - y), s) for w in (np.bincount(rng.integers(0, 1500, 1500), minlength=1500) for _ in range(200))]
    assert rows["fine"]["ci_lo"] == pytest.approx(np.percentile(plain, 2.5), abs=0.01) and rows["fine"]["ci_hi"] == pytest.approx(np.percentile(plain, 97.5), abs=0.01)
    assert rows["one"]["ci_lo"] == rows["one"]["ci_hi"] == 0.5
    report = resampling.method_report(bank, 50)
    assert [r["method"] for r in report.collect()][0] == "fine" and report.columns[:5] == ["method", "auc", "ap", "ci_lo", "ci_hi"]
    single = bank.where("y = 0")
    assert {(r["auc"], r["ci_lo"], r["ci_hi"]) for r in resampling.bootstrap_auc(single, 8).collect()} == {(0.5, 0.5, 0.5)}
    assert resampling.bootstrap_auc(bank.limit(0), 8).count() == 0


@pytest.mark.parametrize("n1,n2", [(1, 1), (1, 6), (3, 4), (5, 3), (4, 4)])
def test_exact_tail_against_all_orders(n1, n2):
    found = [sum(r for r in c) - n1 * (n1 - 1) // 2 for c in itertools.combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        far = max(u, n1 * n2 - u)
        assert resampling.exact_tail(u, n1, n2) == pytest.approx(min(1.0, 2 * sum(x >= far for x in found) / len(found)))


def test_exact_tail_of_a_large_sample_nears_the_normal_one():
    n1, n2 = 8, 50_000
    sd = math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    u = n1 * n2 / 2 - 1.5 * sd
    assert resampling.exact_tail(round(u), n1, n2) == pytest.approx(math.erfc(1.5 / math.sqrt(2)), abs=0.01)


def test_feature_discrimination(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i < 5), [float(v) for v in (i < 5) * np.array([9.0, 1.0, 0.0]) + rng.normal(size=3)] + [float(i % 2)]) for i in range(20)]
    df = spark.createDataFrame(rows, "y int, x array<double>")
    got = resampling.feature_discrimination(df, ["a", "b", "c", "d"]).collect()
    assert got[0]["feature_name"] == "a" and got[0]["effect_size"] == 1.0 and got[0]["significant"]
    assert got[0]["p_value"] == pytest.approx(2 / math.comb(20, 5))
    tied = next(r for r in got if r["feature_name"] == "d")
    assert tied["p_value"] == pytest.approx(next(r["p_value"] for r in evaluation.mann_whitney(df.selectExpr("y", "posexplode(x) as (feature, value)")).collect() if r["feature"] == 3))
    assert [r["effect_size"] for r in got] == sorted((r["effect_size"] for r in got), reverse=True)
    assert resampling.feature_discrimination(df).first()["feature_name"] == "Feature 0"
    with pytest.raises(ValueError):
        resampling.feature_discrimination(df, ["a"])
    assert resampling.feature_discrimination(df.limit(0), ["a"]).count() == 0


def test_cascade_report_against_a_loop(spark, bank):
    f = bank.toPandas().pivot(index="sample_idx", columns="method", values="score")
    y = bank.where("method = 'one'").toPandas().set_index("sample_idx").loc[f.index, "y"].to_numpy()
    far, n = 0.02, int((y == 0).sum())
    budget = int(far * n)
    alone = {m: int((f[m].to_numpy()[y == 1] >= np.sort(f[m].to_numpy()[y == 0])[::-1][budget]).sum()) for m in f}
    order = sorted(alone, key=lambda m: (-alone[m], m))
    assert cases.cascade_order(bank, far) == order
    flagged, want = np.zeros(len(y), bool), []
    for m in ["fine", "tied", "one"]:
        left, s = budget - int(flagged[y == 0].sum()), f[m].to_numpy()
        cut = np.sort(s[(y == 0) & ~flagged])[::-1][left - 1] if left > 0 else None
        if cut is not None:
            flagged |= s >= cut
        want.append((m, int(flagged[y == 1].sum()), int(flagged[y == 0].sum()), cut is None))
    got = cases.cascade_report(bank, far, ["fine", "tied", "one"]).collect()
    assert [(r["method"], r["cum_anomalies"], r["cum_background"], r["skipped"]) for r in got] == want
    assert got[-1]["tpr"] == pytest.approx(want[-1][1] / (y == 1).sum()) and got[-1]["far"] == pytest.approx(want[-1][2] / n)
