import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkburst.functions.wavelets import DB4, wavelet_energies
from sparkburst.operators import detectors, signal
from sparkburst.operators import feature_bank as feature_bank_module
from sparkburst.operators.feature_bank import STEPS, augment, augmented_features, blur, coupling_features, feature_bank, physics_features
from sparkburst.sources import products


def test_peak_of_a_tone():
    fs, t = 37_500.9375, np.arange(4096) / 37_500.9375
    power = signal.segment_power(np.sin(2 * np.pi * 1000 * t), 1024)
    assert power.shape == (4, 513) and (power[:, 1:].argmax(axis=1) + 1 == 27).all()
    assert np.log10(power[0, 27]) == pytest.approx(-0.354, abs=0.01) and fs > 0


def test_short_burst_has_no_frame():
    assert signal.segment_power(np.ones(5), 16).shape == (0, 9)


def test_physics_features_of_a_ramp():
    got = physics_features(np.arange(20.0).reshape(4, 5))
    assert len(got) == 75
    assert got[:5] == pytest.approx([2, 1.414214, -1.3, 0, 3.6], abs=1e-5)
    assert got[20:40].tolist() == [0] * 20
    assert got[40:45] == pytest.approx([1.414214, 0, 1, 1, 5.59017], abs=1e-5)
    assert got[45:48] == pytest.approx([1.011404, 0.583333, 0.186339], abs=1e-5)
    assert got[48:53] == pytest.approx([0.75, 0, 0, 0, 0])
    assert got[66:70] == pytest.approx([1, 0, 1, 1], abs=1e-6)
    assert got[70:] == pytest.approx([9.5, 5.766281, -1.206015, 0, 18.62], abs=1e-4)


def test_wavelets_and_coupling():
    assert DB4.sum() == pytest.approx(2**0.5, abs=1e-9) and (DB4**2).sum() == pytest.approx(1, abs=1e-9)
    energies = wavelet_energies(np.random.default_rng(0).normal(size=(64, 64)))
    assert len(energies) == 13 and energies.sum() == pytest.approx(1) and not wavelet_energies(np.ones((4, 5))).any()
    x = np.random.default_rng(1).normal(size=(9, 5))
    assert len(coupling_features(x, x[:4])) == 10 and coupling_features(x, x)[:4] == pytest.approx([1] * 4, abs=1e-6)


def test_feature_bank_and_augmentation(spark):
    rows = [(0, np.arange(20.0).reshape(4, 5).tolist(), None), (1, np.ones((4, 5)).tolist(), np.ones((4, 5)).tolist())]
    specs = spark.createDataFrame(rows, "sample_idx long, spec array<array<double>>, aux array<array<double>>")
    assert {len(r["features"]) for r in feature_bank(specs).collect()} == {75}
    assert {len(r["features"]) for r in feature_bank(specs, "aux").collect()} == {85}
    a = sorted(map(str, augment(specs.repartition(1), 2).collect()))
    assert len(a) == 4 and a == sorted(map(str, augment(specs.repartition(3), 2).collect()))


def test_spectrogram_of_a_long_burst_in_blocks(spark):
    rng = np.random.default_rng(9)
    v = {1: rng.normal(size=2_000), 2: rng.normal(size=33), 3: rng.normal(size=15), 4: rng.normal(size=16)}
    rows = [(b, i, float(x)) for b, values in v.items() for i, x in enumerate(values)]
    bursts = spark.createDataFrame(rows, "burst_id int, i int, v double").repartition(5)
    for frames in (1, 3, 1000):
        got = {(r["burst_id"], r["k"], r["m"]): r["p_log"] for r in signal.spectrogram(bursts, 16, block_frames=frames).collect()}
        want = {(b, k, m + 1): p for b, values in v.items() for k, line in enumerate(signal.segment_power(values, 16)[:, 1:]) for m, p in enumerate(np.log10(line))}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(want[x], rel=1e-9) for x in want), frames
    blocks = signal.spectrogram(bursts, 16, block_frames=3)
    assert "FlatMapGroupsInPandas" in blocks._jdf.queryExecution().toString()


def test_spectrograms_of_many_bursts_are_made_at_once(spark, monkeypatch):
    rng = np.random.default_rng(9)
    far = 2**62  # ids beyond doubles
    given = {far + i: rng.normal(size=n) for i, n in enumerate((15, 16, 90, 1, 30, 33))} | {None: rng.normal(size=40)}
    rows = [(name, i, float(v)) for name, x in given.items() for i, v in enumerate(x)]
    bursts = spark.createDataFrame(rows, "burst_id long, i int, v double").repartition(5)
    want = {(name, k, m): np.log10(p) for name, x in given.items() for k, line in enumerate(signal.segment_power(x, 16)) for m, p in enumerate(line) if m}
    for size in (10**6, 50):
        monkeypatch.setattr(signal, "GROUP", size)
        made = signal.spectrogram(bursts, 16, block_frames=2)
        got = {(r["burst_id"], r["k"], r["m"]): r["p_log"] for r in made.collect()}
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(want[c]) for c in want)
        keys = {c.split("#")[0].strip(" '[") for c in made._jdf.queryExecution().logical().toString().split("FlatMapGroupsInPandas ")[1].split("]")[0].split(",")}
        assert keys == {"_group", "_none"}  # not a call for each burst


def test_only_long_bursts_are_numbered_over_ranges(spark, monkeypatch):
    rows = [(e, 1 if e % 2 else e // 2 % 15 + 2, f"2024-01-01 00:00:{e * 7 % 60:02d}" if e % 9 else None, float(e)) for e in range(300)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    found, plans = [], []
    for whole in (1_000, 30, 0):  # none, one and all are long
        monkeypatch.setattr(signal, "WHOLE", whole)
        bursts = signal.event_bursts(events)
        plans.append(bursts._jdf.queryExecution().optimizedPlan().toString())
        found.append(sorted((r["burst_id"], r["i"], r["v"]) for r in bursts.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 300
    assert ["_range" in p for p in plans] == [False, True, True]


def test_features_are_dealt_by_the_number_of_spectrograms(spark, monkeypatch):
    monkeypatch.setattr(feature_bank_module, "SPECS", 3)
    specs = spark.createDataFrame([(i, [[float(i), 1.0], [2.0, 3.0]]) for i in range(10)], "sample_idx long, spec array<array<double>>").coalesce(1)
    made = feature_bank(specs)
    assert made.rdd.getNumPartitions() == 4 and {r["sample_idx"] for r in made.collect()} == set(range(10))


def test_samples_are_numbered_over_ranges(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i), int(rng.choice([7, 7, 7, 8])), f"2020-01-01 00:00:{rng.integers(0, 60):02d}" if i % 50 else None, float(i)) for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, user_id int, ts string, value double").withColumn("ts", F.to_timestamp("ts")).repartition(4)
    got = {(r["burst_id"], r["i"]): r["v"] for r in signal.event_bursts(events).collect()}
    for user in (7, 8):
        order = sorted((r for r in rows if r[1] == user), key=lambda r: (r[2] or "", r[0]))
        assert [got[user, i] for i in range(len(order))] == [r[3] for r in order]
    assert len(got) == 400


def test_blur_is_the_weighted_mean_with_mirrored_edges():
    x, sigma = np.random.default_rng(7).normal(size=(5, 3)), 0.8
    reach = int(4 * sigma + 0.5)
    mirror = lambda i, n: (i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n))
    w = {k: np.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)}
    total = sum(w.values())
    for i in range(5):
        for j in range(3):
            want = sum(w[a] * w[b] / total**2 * x[mirror(i + a, 5), mirror(j + b, 3)] for a in w for b in w)
            assert blur(x, sigma)[i, j] == pytest.approx(want)


def test_each_step_of_augmentation():
    x, keys = np.arange(12.0).reshape(3, 4), np.array([5])
    scale, noise, down, along, smear = (change for _, _, change in STEPS)
    assert np.array_equal(scale(x, 1.1, keys), x * 1.1) and np.array_equal(smear(x, 0.5, keys), blur(x, 0.5))
    assert np.array_equal(down(x, -1.5, keys), np.roll(x, -2, axis=0)) and np.array_equal(along(x, 2.9, keys), np.roll(x, 2, axis=1))
    big = np.random.default_rng(0).normal(size=(60, 60))
    assert (noise(big, 0.05, keys) - big).std() == pytest.approx(0.05 * big.std(), rel=0.05)


def test_augmented_copies_and_their_mates(spark):
    rows = [(i * 3, np.full((4 + i % 2, 5), 10.0**i).tolist()) for i in range(4)]
    specs = spark.createDataFrame(rows, "sample_idx long, spec array<array<double>>")
    got = augment(specs, 200, 1).collect()
    assert len(got) == 800 and all(np.array(r["spec"]).shape == (4, 5) for r in got)
    own = {i * 3: 10.0**i for i in range(4)}
    off = [abs(np.log10(np.mean(r["spec"]) / own[r["sample_idx"]])) > 0.1 for r in got]  # far from its own level: mixed with another
    assert 0.08 < np.mean(off) < 0.25
    plain = [np.mean(r["spec"]) / own[r["sample_idx"]] for r, far in zip(got, off) if not far]
    assert 0.8 < min(plain) and max(plain) < 1.25 and np.std(plain) > 0.03
    made = augmented_features(specs, 2).collect()
    assert len(made) == 8 and {len(r["features"]) for r in made} == {75}
    assert not augment(specs.where("false")).collect()


def test_copies_without_a_mate_are_spread_over_tasks(spark):
    bank = spark.range(400).select(F.col("id").alias("sample_idx"), F.array(F.array(F.col("id").cast("double"))).alias("spec"))
    copies = bank.select("sample_idx").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(9))))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        place = F.when(F.col("copy") == 0, 399 - F.col("sample_idx"))
        rows = feature_bank_module._mated(copies, bank, place).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 4_000 and all(r["_mate"] == ([[399.0 - r["sample_idx"]]] if r["copy"] == 0 else None) for r in rows)
    tasks = [r["task"] for r in rows]
    assert max(map(tasks.count, set(tasks))) < 1_500


def test_smoothing_by_hand(spark):
    p = np.random.default_rng(5).normal(size=(5, 4))
    cells = spark.createDataFrame([(0, m, k, float(p[m, k])) for m in range(5) for k in range(4)], "id int, m int, k int, p double")
    got = {(r["m"], r["k"]): r["p"] for r in signal.smooth(cells, 3, 2).collect()}
    rows = np.pad(p, [(1, 1), (0, 0)], mode="edge")
    tall = (rows[:-2] + rows[1:-1] + rows[2:]) / 3
    wide = np.pad(tall, [(0, 0), (1, 0)], mode="edge")
    want = (wide[:, :-1] + wide[:, 1:]) / 2
    assert all(got[m, k] == pytest.approx(want[m, k]) for m in range(5) for k in range(4))


def test_resize_grids():
    x = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert signal.resize(x, 3, 3)[1, 1] == 1.5 and signal.resize(x, 3, 3)[0].tolist() == [0, 0.5, 1]
    assert signal.resize(x, 4, 4, corners=False)[0].tolist() == [0, 0.25, 0.75, 1]


def test_nearest_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(detectors, "BANK_BLOCK", 7)
    x = np.random.default_rng(2).normal(size=(30, 3))
    rows = spark.createDataFrame([(i, int(i % 3 == 0), x[i].tolist()) for i in range(30)], "sample_idx long, label int, x array<double>")
    got = {r["sample_idx"]: r["score"] for r in detectors.knn_distance(rows, 4).collect()}
    bank = x[[i for i in range(30) if i % 3]]
    want = np.sort(np.sqrt(((x[:, None] - bank) ** 2).sum(axis=2)), axis=1)[:, :4].mean(axis=1)
    assert all(got[i] == pytest.approx(want[i], abs=1e-6) for i in range(30))


def test_all_background_counts_and_ties_go_by_id(spark, monkeypatch):
    """Every background row is a neighbour, whatever its id, and of equal ones the least id comes first, over blocks too."""
    from pyspark.sql import functions as F

    far = spark.range(200_001).select(F.col("id").alias("sample_idx"), F.lit(0).alias("label"), F.array(F.lit(5.0) + F.col("id"), F.lit(0.0)).alias("x"))
    queries = spark.createDataFrame([(900_000 + i, [5.0 + i, 0.0]) for i in range(0, 200_001, 500)], "sample_idx long, x array<double>")
    got = detectors.nearest(queries, detectors.background(far), 1).collect()
    assert len(got) == 401 and all(r["distance"] == 0 and r["neighbour"] == r["sample_idx"] - 900_000 for r in got)

    monkeypatch.setattr(detectors, "BANK_BLOCK", 7)
    monkeypatch.setattr(detectors, "QUERY_BLOCK", 5)
    same = spark.createDataFrame([(i, 0, [1.0, float(i >= 50)]) for i in range(60)], "sample_idx long, label int, x array<double>")
    near = detectors.nearest(same, same, 3, leave_self_out=True).collect()
    for i in range(60):
        want = [j for j in (range(50) if i < 50 else range(50, 60)) if j != i][:3]
        assert [r["neighbour"] for r in sorted((r for r in near if r["sample_idx"] == i), key=lambda r: r["rank"])] == want


def test_later_blocks_of_the_bank_cost_products_only(spark, monkeypatch):
    rng = np.random.default_rng(12)
    rows = rng.normal(size=(6_000, 16))
    rows[4_000] = rows[10]  # a tie that goes to the lesser id
    rows[5_000] = np.nan
    ids = np.arange(6_000)
    true = np.sqrt(((rows[:40, None] - rows[None]) ** 2).sum(axis=2))
    true[np.arange(40), np.arange(40)] = np.inf
    wanted = [np.lexsort((ids, np.round(d, 9)))[:3].tolist() for d in true]
    limit = np.array([np.sort(d[:3_000])[2] for d in true])
    seen = []
    near = detectors._k_nearest
    monkeypatch.setattr(detectors, "_k_nearest", lambda row, *rest: seen.append(len(row)) or near(row, *rest))
    detectors._near_pairs(rows[:40], ids[:40], rows[3_000:], ids[3_000:], 3, True, limit)
    assert seen[0] < 40 * 6  # few pairs of a later block are looked at
    monkeypatch.undo()
    monkeypatch.setattr(detectors, "BANK_BLOCK", 1_000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(rows)], "sample_idx long, x array<double>")
    got = detectors.nearest(df.where("sample_idx < 40"), df, 3, leave_self_out=True).orderBy("sample_idx", "rank").collect()
    assert [[r["neighbour"] for r in got if r["sample_idx"] == i] for i in range(40)] == wanted
    huge = detectors.nearest(df.where("sample_idx < 5").withColumn("x", F.transform("x", lambda v: v * 1e20)), df.where("sample_idx < 900").withColumn("x", F.transform("x", lambda v: v * 1e20)), 1)
    assert {(r["sample_idx"], r["neighbour"]) for r in huge.collect()} == {(i, i) for i in range(5)}


def test_download_plans(spark):
    assert products.date_range(spark, "2020-09-27", "2020-09-25").count() == 0
    assert products.download_plan(spark, "dvac12", start="2020-09-25", end="2020-09-27").count() == 12
    half = products.download_plan(spark, "vac12", day="2020-09-25", hour="06", start="2020-01-01")
    assert [r["name"] for r in half.collect()] == ["vac12_2020092506.cdf"]
    with pytest.raises(ValueError):
        products.download_plan(spark, "vac12", end="2020-01-01")
    one = products.download_plan(spark, "vac12", day="2020-09-25", hour="06").first()
    assert one["name"] == "vac12_2020092506.cdf"
    with pytest.raises(ValueError):
        products.download_plan(spark, "vac12", day="2020-09-25", hour="07")


def test_transfers_have_a_status_each(spark, tmp_path):
    source, folder = tmp_path / "served", tmp_path / "kept"
    source.mkdir(), folder.mkdir()
    (folder / "k_2020092500.cdf").write_text("old")
    for hour in ("00", "06", "18"):
        (source / f"k_20200925{hour}.cdf").write_text(hour)
    plan = products.download_plan(spark, "k", day="2020-09-25", all_hours=True)
    got = products.transfer(plan, f"file://{source}/{{name}}", str(folder), tasks=2)
    rows = {r["name"][-6:-4]: (r["status"], r["path"]) for r in got.collect()}
    assert {h: s for h, (s, _) in rows.items()} == {"00": "skipped", "06": "downloaded", "12": "failed", "18": "downloaded"}
    assert rows["12"][1] is None and rows["06"][1] == str(folder / "k_2020092506.cdf")
    assert sorted((p.name, p.read_text()) for p in folder.iterdir()) == [("k_2020092500.cdf", "old"), ("k_2020092506.cdf", "06"), ("k_2020092518.cdf", "18")]
    assert tuple(products.transfer_counts(got).first()) == (1, 2, 1)
    assert tuple(products.transfer_counts(products.transfer(plan.limit(0), "x", str(folder))).first()) == (0, 0, 0)


def test_products_of_a_table(spark):
    rows = spark.createDataFrame([("2020-09-25 05:59:59",), ("2020-09-25 06:00:00",), ("2020-09-25 11:00:00",), ("2020-09-27 23:00:00",), (None,)], "ts string").selectExpr("cast(ts as timestamp) ts")
    assert sorted(r["name"] for r in products.plan_of_times(rows, "k").collect()) == ["k_2020092500.cdf", "k_2020092506.cdf", "k_2020092718.cdf"]
    whole = products.range_of_times(rows, "k")
    assert whole.count() == 12 and products.range_of_times(rows.where("ts is null"), "k").count() == 0
    one = products.with_address(whole.where("day = '2020-09-27' and hour = '18'"), "a/{kind}/{year}-{month}-{day}/{hour}/{name}?{other}").first()
    assert one["url"] == "a/k/2020-09-27/18/k_2020092718.cdf?{other}"
