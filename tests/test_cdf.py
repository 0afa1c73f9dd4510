"""CDF files written here record by record, read back by the source; leap seconds; bursts to spectrograms."""

import gzip
import struct

import numpy as np
import pytest

from sparkburst.operators import signal
from sparkburst.operators.feature_bank import coupling_features, feature_bank, physics_features, prepare_bank, with_channel
from sparkburst.sources import cdf

CODES = {"f4": 44, "f8": 45, "i4": 4, "i8": 33, "S": 51}


def record(kind, body):
    return struct.pack(">qi", len(body) + 12, kind) + body


def write_cdf(path, variables, order=">", row_major=True, squeeze=False, whole=False):
    """A file with zVariables {name: (array or list with gaps, per-block sizes)}; text as arrays of bytes."""
    out = bytearray(struct.pack(">II", 0xCDF30001, 0xFFFF))

    def put(data):
        at = len(out)
        out.extend(data)
        return at

    cdr = put(record(1, struct.pack(">qiiiiiiiii", 0, 3, 9, 6 if order == "<" else 1, int(row_major), 0, 0, 0, 0, 0) + bytes(256)))
    gdr = put(record(2, bytes(84 - 12)))
    struct.pack_into(">q", out, cdr + 12, gdr)
    heads = []
    for name, (values, blocks, varies) in variables.items():
        text = values.dtype.kind == "S"
        elements, shape = (values.dtype.itemsize if text else 1), values.shape[1:]
        packing = put(record(11, struct.pack(">iiii", 5, 0, 1, 6))) if squeeze else -1
        spans = []
        for first, last in blocks:
            part = values[first : last + 1]
            part = part if row_major or len(shape) < 2 else np.stack([r.T for r in part])
            data = (part if text else part.astype(part.dtype.newbyteorder(order))).tobytes()
            packed = gzip.compress(data)
            spans.append((first, last, put(record(13, struct.pack(">iq", 0, len(packed)) + packed) if squeeze else record(7, data))))

        def index(entries):
            table = struct.pack(f">{len(entries)}i", *[e[0] for e in entries]) + struct.pack(f">{len(entries)}i", *[e[1] for e in entries]) + struct.pack(f">{len(entries)}q", *[e[2] for e in entries])
            return record(6, struct.pack(">qii", 0, len(entries), len(entries)) + table)

        if len(spans) > 2:  # two levels
            inner = put(index(spans[1:]))
            spans = [spans[0], (spans[1][0], spans[-1][1], inner)]
        vxr = put(index(spans))
        kind = 51 if text else CODES[values.dtype.str[1:]]
        body = struct.pack(">qiiqqiiiiiiiqi", 0, kind, max(b[1] for b in blocks), vxr, vxr, int(varies) | (4 if squeeze else 0), 0, 0, -1, -1, elements, len(heads), packing, 0)
        body += name.encode().ljust(256, b"\0") + struct.pack(f">i{2 * len(shape)}i", len(shape), *shape, *[-1] * len(shape))
        heads.append(put(record(8, body)))
    for a, b in zip(heads, heads[1:]):
        struct.pack_into(">q", out, a + 12, b)
    struct.pack_into(">qq", out, gdr + 12, 0, heads[0])
    if whole:
        packed = gzip.compress(bytes(out[8:]))
        ccr = struct.pack(">qiqqi", 32 + len(packed), 10, 8 + 32 + len(packed), len(out) - 8, 0) + packed
        out = bytearray(struct.pack(">II", 0xCDF30001, 0xCCCC0001)) + ccr + record(11, struct.pack(">iiii", 5, 0, 1, 6))
    path.write_bytes(bytes(out))


def sample():
    rng = np.random.default_rng(0)
    return {
        "grid": (rng.normal(size=(9, 2, 3)), [(0, 3), (4, 4), (5, 8)], True),
        "n": (np.arange(9, dtype="i4") * 7 - 5, [(0, 2), (6, 8)], True),
        "word": (np.array([b"ab", b"c", b"", b"defg", b"x", b"y", b"z", b"q", b"r"], "S4"), [(0, 8)], True),
        "rate": (np.array([2.5], "f4"), [(0, 0)], False),
    }


@pytest.mark.parametrize("form", [{}, {"order": "<"}, {"squeeze": True}, {"row_major": False}, {"whole": True, "order": "<"}, {"squeeze": True, "row_major": False}])
def test_round_trip(spark, tmp_path, form):
    made = sample()
    write_cdf(tmp_path / "a.cdf", made, **form)
    rows = sorted(cdf.read_cdf(spark, str(tmp_path), ["grid", "n", "word", "rate"], records=2).collect(), key=lambda r: r["record"])
    assert [r["record"] for r in rows] == list(range(9))
    for i, r in enumerate(rows):
        assert r["grid"] == made["grid"][0][i].ravel().tolist()
        assert r["n"] == (None if 3 <= i <= 5 else i * 7 - 5)
        assert r["word"] == made["word"][0][i].decode() and r["rate"] == 2.5


def test_files_and_columns(spark, tmp_path):
    made = sample()
    write_cdf(tmp_path / "a.cdf", made)
    write_cdf(tmp_path / "b.cdf", {"n": made["n"]})
    every = cdf.read_cdf(spark, f"{tmp_path}/*.cdf")
    assert every.columns == ["path", "record", "grid", "n", "word"] and every.count() == 18
    assert every.where("path like '%b.cdf' and grid is null").count() == 9
    assert cdf.read_cdf(spark, str(tmp_path), ["n"]).dtypes[2:] == [("n", "bigint")]
    (tmp_path / "c.cdf").write_bytes(b"no such format at all")
    with pytest.raises(Exception, match="no CDF file"):
        cdf.read_cdf(spark, f"{tmp_path}/c.cdf").count()
    with pytest.raises(Exception, match="no file has"):
        cdf.read_cdf(spark, f"{tmp_path}/a.cdf", ["absent"]).count()
    cut = (tmp_path / "a.cdf").read_bytes()
    (tmp_path / "d.cdf").write_bytes(cut[:600])
    with pytest.raises(Exception, match="ends too early"):
        cdf.read_cdf(spark, f"{tmp_path}/d.cdf").count()


def test_leap_seconds(spark):
    # days since 2000-01-01 in seconds, less half a day, plus leap seconds and 32.184
    known = {"2000-01-01 11:58:55.816": 0, "2016-12-31 23:59:59": (6210 * 86400 - 1 - 43200 + 36) * 10**9 + 32_184_000_000, "2017-01-01 00:00:00": (6210 * 86400 - 43200 + 37) * 10**9 + 32_184_000_000}
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, v) for k, v in known.items()], "at string, tt long").withColumn("ns", F.unix_micros(F.col("at").cast("timestamp")) * 1000)
    for r in rows.select("tt", "ns", cdf.unix_ns_to_tt2000(F.col("ns")).alias("made"), cdf.tt2000_to_unix_ns(F.col("tt")).alias("back")).collect():
        assert r["made"] == r["tt"] and r["back"] == r["ns"]
    none = spark.range(1).select(cdf.tt2000_to_unix_ns(F.lit(None).cast("long")).alias("x")).first()["x"]
    assert none is None


def test_bursts_to_spectrograms(spark, tmp_path):
    rng = np.random.default_rng(4)
    volts = {p: rng.normal(size=(3, 64)).astype("f4") for p in (1, 2, 3, 4)}
    times = (np.arange(64)[None, :] * 500_000 + np.arange(3)[:, None] * 10**9 + 10**17).astype("i8")
    blocks = [(0, 2)]
    write_cdf(tmp_path / "v.cdf", {**{f"p_vac{p}": (v, blocks, True) for p, v in volts.items()}, "p_vac_time_series_TT2000": (times, blocks, True), "p_dvac12": (volts[1], blocks, True), "p_dvac_time_series_TT2000": (times, blocks, True)})
    path = str(tmp_path / "v.cdf")
    for kind, probes, want in (("dvac", "12", volts[1]), ("vac", "12", volts[1] - volts[2]), ("vac", "34", volts[3] - volts[4]), ("vac", "other", volts[3] - volts[4])):
        got = sorted(cdf.load_bursts(spark, path, kind, probes, records=1).collect(), key=lambda r: (r["burst_id"], r["i"]))
        assert np.allclose([r["v"] for r in got], want.ravel(), atol=1e-6) and [r["ns"] for r in got] == times.ravel().tolist()
    with pytest.raises(ValueError):
        cdf.load_bursts(spark, path, "ac")
    made = signal.timed_spectrogram(cdf.load_bursts(spark, path), 16)
    one = signal.spectrogram(cdf.load_bursts(spark, path).select("burst_id", "i", "v"), 16, fs=2000.0)
    key = lambda r: (r["burst_id"], r["k"], r["m"])
    for a, b in zip(sorted(made.collect(), key=key), sorted(one.collect(), key=key), strict=True):
        assert [a["t"], a["f_log"], a["p_log"]] == pytest.approx([b["t"], b["f_log"], b["p_log"]]) and a["fs"] == 2000 and a["start_ns"] == 10**17 + a["burst_id"] * 10**9


def test_second_channel_and_preparation(spark):
    rng = np.random.default_rng(6)
    specs = {i: rng.normal(size=(16, 12)) for i in range(5)}
    others = {i: rng.normal(size=(16, 12 if i != 2 else 9)) for i in (0, 1, 2, 7)}
    frame = lambda d: spark.createDataFrame([(i, x.tolist()) for i, x in d.items()], "sample_idx long, spec array<array<double>>")
    both = with_channel(frame(specs), frame(others))
    for channel in ("channel", "auto"):
        got = {r["sample_idx"]: r["features"] for r in feature_bank(both, channel).collect()}
        assert set(got) == set(specs)
        for i, s in specs.items():
            assert got[i] == pytest.approx(np.concatenate([physics_features(s), coupling_features(s, others.get(i, s))]).tolist(), abs=1e-5)
    assert {len(r["features"]) for r in feature_bank(frame(specs), "auto").collect()} == {75}
    empty = spark.createDataFrame([(0, specs[0].tolist(), [])], "sample_idx long, spec array<array<double>>, channel array<array<double>>")
    assert feature_bank(empty, "channel").first()["features"][75:] == pytest.approx(coupling_features(specs[0], specs[0]).tolist(), abs=1e-5)
    noise = spark.createDataFrame([(1,), (3,), (3,)], "sample_idx long")
    bank, mean, std = prepare_bank(frame(specs), noise, 8, 6)
    small = {i: signal.resize(s, 8, 6, False) for i, s in specs.items()}
    assert mean == pytest.approx(np.mean([small[1], small[3]])) and std == pytest.approx(np.std([small[1], small[3]], ddof=1) + 1e-6)
    for r in bank.collect():
        assert np.allclose(r["spec"], (small[r["sample_idx"]] - mean) / std)
    with pytest.raises(ValueError):
        prepare_bank(frame(specs), noise.where("sample_idx > 9"), 8, 6)
