"""Queries over bursts of ``events`` and vectors of ``embeddings``, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detectors as de
from ..operators import features as fe
from ..operators import signal as si
from ..operators.feature_bank import feature_bank, specs_from_cells, with_channel
from ..operators.scores import labelled_vectors
from ..sources.cdf import LEAP_DAYS, tt2000_to_unix_ns, unix_ns_to_tt2000
from ..sources.stored import stored
from ..sources.tables import read_table
from .score_queries import BANK, _sql, rounded

NPERSEG = 16


def bursts(spark, sf_dir):
    return si.event_bursts(read_table(spark, sf_dir, "events"))


def raw_cells(spark, sf_dir):
    """Spectrogram cells (id, m, k, p) of the users' bursts."""
    return stored(si.spectrogram(bursts(spark, sf_dir), NPERSEG).select(F.col("burst_id").alias("id"), (F.col("m") - 1).alias("m"), "k", F.col("p_log").alias("p")))


def cells(spark, sf_dir):
    """The cells with their power rounded, so that ties agree across engines."""
    return raw_cells(spark, sf_dir).withColumn("p", F.round("p", 6))


def _channels(spark, sf_dir):
    events = read_table(spark, sf_dir, "events")
    a, b = (si.event_bursts(events.where(F.pmod("event_id", F.lit(2)) == n)) for n in (0, 1))
    return a, b


def _differential(spark, sf_dir):
    return rounded(si.differential(*_channels(spark, sf_dir)))


def _frequency(spark, sf_dir):
    return rounded(si.sampling_frequency(bursts(spark, sf_dir).withColumn("ns", F.col("us") * 1000)), 9)


def _coupling(spark, sf_dir):
    a, b = _channels(spark, sf_dir)
    one, two = (si.spectrogram(x, NPERSEG).select(F.col("burst_id").alias("id"), (F.col("m") - 1).alias("m"), "k", F.round("p_log", 6).alias("p")) for x in (a, b))
    return rounded(fe.row_coupling(stored(si.align_pair(one, two))), 5)


def _on_cells(f, digits=5):
    return lambda spark, sf_dir: rounded(f(cells(spark, sf_dir)), digits)


def _cropped(spark, sf_dir):
    return stored(si.align_to_least(cells(spark, sf_dir)))


def _against_background(f):
    """``f`` of all cropped spectrograms and those of the background, from one stored table."""

    def run(spark, sf_dir):
        c = _cropped(spark, sf_dir)
        return rounded(f(c, _background(c)), 4)

    return run


def _background(c):
    return c.where(F.pmod("id", F.lit(10)) < 8)


def _vectors(spark, sf_dir):
    return labelled_vectors(read_table(spark, sf_dir, "embeddings"))


def _on_vectors(f, digits=5):
    return lambda spark, sf_dir: rounded(f(_vectors(spark, sf_dir)), digits)


def _patch(name):
    """A usual local patch detector on all bursts' spectrograms, whatever their lengths, against users whose id doesn't end in 8 or 9."""

    def run(spark, sf_dir):
        shown = stored(specs_from_cells(raw_cells(spark, sf_dir)))
        found = de.local_patch_resized(shown, shown.where("sample_idx % 10 < 8"), *de.PATCH_SIZES[name])
        return found.select("sample_idx", F.round("score", 5).alias("score"))

    return run


def _coupling_bank(spark, sf_dir):
    """Features of the even events' spectrograms with the odd events' as second channel, found by its shape where the first row's agree."""
    one, two = (specs_from_cells(si.spectrogram(x, NPERSEG).select(F.col("burst_id").alias("id"), (F.col("m") - 1).alias("m"), "k", F.round("p_log", 6).alias("p"))) for x in _channels(spark, sf_dir))
    return feature_bank(with_channel(one, two), "channel")


def _times(spark, sf_dir):
    ns = F.unix_micros(F.col("ts").cast("timestamp")) * 1000
    times = read_table(spark, sf_dir, "events").select("event_id", unix_ns_to_tt2000(ns).alias("tt2000"))
    return times.withColumn("unix_ns", tt2000_to_unix_ns(F.col("tt2000")))


QUERIES = {
    "spectrogram": lambda s, d: rounded(si.spectrogram(bursts(s, d), NPERSEG)),
    "sampling_frequency": _frequency,
    "differential_voltage": _differential,
    "band_moments": _on_cells(fe.band_moments, 4),
    "global_moments": lambda s, d: rounded(fe.global_moments(raw_cells(s, d)), 4),
    "temporal_features": lambda s, d: rounded(fe.temporal_features(raw_cells(s, d)), 5),
    "spectral_shape": _on_cells(fe.spectral_shape),
    "peak_track": _on_cells(fe.peak_track),
    "band_correlation": _on_cells(fe.band_correlation),
    "row_coupling": _coupling,
    "coupling_bank": _coupling_bank,
    "tt2000_times": _times,
    "local_patch_small": _patch("LP_Small"),
    "local_patch_micro": _patch("LP_Micro"),
    "robust_normalise": _on_cells(si.robust_normalise),
    "pixel_zscore": lambda s, d: rounded(de.pixel_moments(_cropped(s, d)), 5),
    "uniform_smooth": lambda s, d: rounded(si.smooth(si.align_to_least(raw_cells(s, d)), 3, 2), 5),
    "local_patch": _against_background(lambda c, b: de.local_patch_score(c, b, 3, 2)),
    "band_deviation": _against_background(de.band_deviation),
    "roll_shift": lambda s, d: rounded(si.roll(_cropped(s, d), 3, -1, 8, 3)),
    "align_crop": lambda s, d: rounded(_cropped(s, d)),
    "mahalanobis_diag": _on_vectors(de.diagonal_mahalanobis),
    "knn_distance": _on_vectors(lambda v: de.knn_distance(v, 5)),
    "lof": _on_vectors(lambda v: de.local_outlier_factor(v, 5)),
    "patch_knn_max": _on_vectors(lambda v: de.patch_knn(v, 4, 3)),
    "pca_recon": _on_vectors(de.pca_residual),
    "isolation_forest": _on_vectors(de.isolation_forest),
}

BURSTS = "bu AS (SELECT user_id AS burst_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v, epoch_us(ts) AS us FROM events)"


def _spec_sql(source: str, name: str) -> str:
    """Spectrogram cells of a burst table by DFT sums."""
    return f"""{name}_n AS (SELECT burst_id, count(*) AS n FROM {source} GROUP BY burst_id),
{name}_f AS (SELECT burst_id, unnest(range(0, CASE WHEN n < 16 THEN 0 ELSE (n - 16) // 14 + 1 END)) AS k FROM {name}_n),
{name}_w AS (SELECT f.burst_id, f.k, b.i - 14 * f.k AS j, (b.v - avg(b.v) OVER (PARTITION BY f.burst_id, f.k)) * (0.5 - 0.5 * cos(2 * pi() * (b.i - 14 * f.k) / 16)) AS x FROM {name}_f f JOIN {source} b ON b.burst_id = f.burst_id AND b.i BETWEEN 14 * f.k AND 14 * f.k + 15),
{name} AS (SELECT burst_id, k, m, log10(greatest((pow(sum(x * cos(2 * pi() * m * j / 16)), 2) + pow(sum(x * sin(2 * pi() * m * j / 16)), 2)) / 64 * CASE WHEN m = 8 THEN 1 ELSE 2 END, 2.2250738585072014e-308)) AS p_log FROM {name}_w, range(1, 9) q(m) GROUP BY burst_id, k, m)"""


SPEC = BURSTS + ",\n" + _spec_sql("bu", "sp")
CELLS = SPEC + ",\nc AS (SELECT burst_id AS id, m - 1 AS m, k, round(p_log, 6) AS p FROM sp)"
RAW = SPEC + ",\nc AS (SELECT burst_id AS id, m - 1 AS m, k, p_log AS p FROM sp)"
MOMENTS = "round(avg(p), 4) AS mean, round(stddev_pop(p), 4) AS std, round(CASE WHEN stddev_pop(p) < 1e-12 THEN 0 ELSE coalesce(kurtosis_pop(p), 0) END, 4) AS kurtosis, round(CASE WHEN stddev_pop(p) < 1e-12 THEN 0 ELSE coalesce((avg(p*p*p) - 3*avg(p)*avg(p*p) + 2*pow(avg(p), 3)) / pow(stddev_pop(p), 3), 0) END, 4) AS skew"
CROP = "cr AS (SELECT c.* FROM c, (SELECT min(h) AS h, min(w) AS w FROM (SELECT id, max(m) AS h, max(k) AS w FROM c GROUP BY id)) WHERE m <= h AND k <= w)"


def _corr(x: str, y: str) -> str:
    return f"CASE WHEN stddev_pop({x}) * stddev_pop({y}) > 1e-12 THEN covar_pop({x}, {y}) / (stddev_pop({x}) * stddev_pop({y})) ELSE 0 END"


DIST = "ds AS (SELECT a.sample_idx, b.sample_idx AS nb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM x a JOIN x b ON a.d = b.d AND b.label = 0 GROUP BY a.sample_idx, b.sample_idx)"
SMOOTH = """h1 AS (SELECT id, m, k, p, first_value(p) OVER u AS f, last_value(p) OVER (PARTITION BY id, k ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, max(m) OVER (PARTITION BY id, k) AS top FROM {0} WINDOW u AS (PARTITION BY id, k ORDER BY m)),
h2 AS (SELECT id, m, k, (sum(p) OVER (PARTITION BY id, k ORDER BY m ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) + f * greatest(1 - m, 0) + l * greatest(m + 1 - top, 0)) / 3 AS p FROM h1),
h3 AS (SELECT id, m, k, p, first_value(p) OVER (PARTITION BY id, m ORDER BY k) AS f FROM h2),
sm AS (SELECT id, m, k, (sum(p) OVER (PARTITION BY id, m ORDER BY k ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) + f * greatest(1 - k, 0)) / 2 AS p FROM h3)"""
ROBUST = "{1} AS (SELECT id, m, k, (p - q2) / greatest(q3 - q1, 1e-6) AS p FROM {0} JOIN (SELECT id, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS q2, quantile_cont(p, 0.75) AS q3 FROM {0} GROUP BY id) USING (id))"
BAND = "bd AS (SELECT c.*, CASE WHEN m < (h % 8) * (h // 8 + 1) THEN m // (h // 8 + 1) ELSE h % 8 + (m - (h % 8) * (h // 8 + 1)) // greatest(h // 8, 1) END AS band FROM c JOIN (SELECT id, max(m) + 1 AS h FROM c GROUP BY id) USING (id))"

LEAPS = ", ".join(f"('{d}', {10 + i})" for i, d in enumerate(LEAP_DAYS))

ORACLES = {
    "tt2000_times": _sql(
        f"lp AS (SELECT CAST(d AS TIMESTAMP) AS d, n FROM (VALUES {LEAPS}) v(d, n))",
        "t AS (SELECT event_id, epoch_us(ts) * 1000 AS unix_ns, CASE WHEN ts IS NOT NULL THEN (SELECT coalesce(max(n), 10) FROM lp WHERE d <= ts) END AS n FROM events)",
        "SELECT event_id, CAST(unix_ns - 946727935816000000 + (n - 32)::BIGINT * 1000000000 AS BIGINT) AS tt2000, CAST(unix_ns AS BIGINT) AS unix_ns FROM t",
    ),
    "spectrogram": _sql(SPEC, "SELECT burst_id, k::BIGINT AS k, m::BIGINT AS m, round((8 + 14 * k)::DOUBLE, 6) AS t, round(log10(m / 16.0), 6) AS f_log, round(p_log, 6) AS p_log FROM sp"),
    "sampling_frequency": _sql(BURSTS, "SELECT burst_id, round(1e9 / nullif((max(CASE WHEN i = 1 THEN us END) - max(CASE WHEN i = 0 THEN us END)) * 1000, 0), 9) AS fs FROM bu WHERE i < 2 GROUP BY burst_id"),
    "differential_voltage": "WITH r AS (SELECT user_id, event_id % 2 AS a, value, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS i FROM events) SELECT p.user_id AS burst_id, p.i, round(p.value - q.value, 6) AS v FROM r p JOIN r q ON p.user_id = q.user_id AND p.i = q.i AND p.a = 0 AND q.a = 1",
    "band_moments": _sql(CELLS, BAND, f"SELECT id, band::BIGINT AS band, {MOMENTS}, round(quantile_cont(p, 0.95) - quantile_cont(p, 0.05), 4) AS range FROM bd GROUP BY id, band"),
    "global_moments": _sql(RAW, f"SELECT id, {MOMENTS}, round(quantile_cont(p, 0.99) - quantile_cont(p, 0.01), 4) AS range FROM c GROUP BY id"),
    "temporal_features": _sql(RAW, "f AS (SELECT id, k, avg(p) AS a, stddev_pop(p) AS s FROM c GROUP BY id, k)", "g AS (SELECT *, a - lag(a) OVER (PARTITION BY id ORDER BY k) AS d FROM f)", "SELECT id, round(stddev_pop(a), 5) AS std_mean, round(coalesce(stddev_pop(d), 0), 5) AS std_diff, round(coalesce(avg(abs(d)), 0), 5) AS abs_diff, round(coalesce(covar_pop(k, a) / nullif(var_pop(k), 0), 0), 5) AS trend, round(avg(s), 5) AS mean_std FROM g GROUP BY id"),
    "spectral_shape": _sql(CELLS, "f AS (SELECT id, m, avg(p) AS a FROM c GROUP BY id, m)", "g AS (SELECT id, m, (a - min(a) OVER w) / (sum(a) OVER w - min(a) OVER w * count(*) OVER w + 1e-10) AS w, count(*) OVER w AS h FROM f WINDOW w AS (PARTITION BY id))", "ce AS (SELECT id, h, sum(w * m) AS ce FROM g GROUP BY id, h)", "SELECT g.id, round(-sum(w * ln(w + 1e-10)), 5) AS entropy, round(max(ce) / max(g.h), 5) AS centroid, round(sqrt(greatest(sum(w * (m - ce) * (m - ce)), 0)) / max(g.h), 5) AS bandwidth FROM g JOIN ce ON g.id = ce.id GROUP BY g.id"),
    "peak_track": _sql(CELLS, "pk AS (SELECT id, k, m::DOUBLE AS peak, h FROM (SELECT id, k, m, row_number() OVER (PARTITION BY id, k ORDER BY p DESC, m) AS r, max(m) OVER (PARTITION BY id) + 1 AS h FROM c) WHERE r = 1)", "g AS (SELECT *, lag(peak) OVER (PARTITION BY id ORDER BY k) AS b FROM pk)", f"r AS (SELECT id, {_corr('peak', 'b')} AS l FROM g WHERE b IS NOT NULL GROUP BY id)", "SELECT g.id, round(avg(peak) / max(h), 5) AS mean, round(stddev_pop(peak) / max(h), 5) AS std, round(coalesce(stddev_pop(peak - b), 0) / max(h), 5) AS step_std, round(coalesce(avg(abs(peak - b)), 0) / max(h), 5) AS step_abs, round(coalesce(max(l), 0), 5) AS lag1 FROM g LEFT JOIN r ON g.id = r.id GROUP BY g.id"),
    "band_correlation": _sql(CELLS, BAND, "f AS (SELECT id, k, band, avg(p) AS a FROM bd GROUP BY id, k, band)", f"r AS (SELECT x.id, x.band, y.band AS o, {_corr('x.a', 'y.a')} AS r FROM f x JOIN f y ON x.id = y.id AND x.k = y.k AND x.band < y.band GROUP BY x.id, x.band, y.band)", "SELECT id, round(avg(r), 5) AS mean, round(stddev_pop(r), 5) AS std, round(max(r), 5) AS most, round(avg(CASE WHEN r > 0.7 THEN 1.0 ELSE 0 END), 5) AS over FROM r GROUP BY id").replace(" AS over ", ' AS "over" '),
    "row_coupling": _sql("ev AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts, event_id) - 1 AS i FROM events)", "b0 AS (SELECT user_id AS burst_id, i, value AS v FROM ev WHERE event_id % 2 = 0)", "b1 AS (SELECT user_id AS burst_id, i, value AS v FROM ev WHERE event_id % 2 = 1)", _spec_sql("b0", "s0"), _spec_sql("b1", "s1"), "pr AS (SELECT a.burst_id AS id, a.m - 1 AS m, a.k, round(a.p_log, 6) AS p, round(b.p_log, 6) AS q FROM s0 a JOIN s1 b ON a.burst_id = b.burst_id AND a.m = b.m AND a.k = b.k)", f"SELECT pr.id, j::BIGINT AS j, round({_corr('p', 'q')}, 5) AS r FROM pr JOIN (SELECT id, max(m) AS top FROM pr GROUP BY id) t ON pr.id = t.id, range(0, 4) g(j) WHERE m = floor(j * top / 3.0) GROUP BY pr.id, j"),
    "robust_normalise": _sql(CELLS, ROBUST.format("c", "rn"), "SELECT id, m::BIGINT AS m, k::BIGINT AS k, round(p, 5) AS p FROM rn"),
    "pixel_zscore": _sql(CELLS, CROP, "SELECT m::BIGINT AS m, k::BIGINT AS k, round(avg(p), 5) AS mean, round(greatest(stddev_pop(p), 1e-3), 5) AS std FROM cr GROUP BY m, k"),
    "uniform_smooth": _sql(RAW, CROP, SMOOTH.format("cr"), "SELECT id, m::BIGINT AS m, k::BIGINT AS k, round(p, 5) AS p FROM sm"),
    "local_patch": _sql(CELLS, CROP, ROBUST.format("cr", "rn"), "ft AS (SELECT m, k, avg(p) AS a, greatest(stddev_pop(p), 1e-3) AS s FROM rn WHERE id % 10 < 8 GROUP BY m, k)", "zz AS (SELECT id, rn.m, rn.k, greatest((p - a) / s, 0) AS p FROM rn JOIN ft ON rn.m = ft.m AND rn.k = ft.k)", SMOOTH.format("zz"), "SELECT id, round(0.7 * quantile_cont(p, 0.995) + 0.3 * max(p), 4) AS score FROM sm GROUP BY id"),
    "band_deviation": _sql(CELLS, CROP, "bp AS (SELECT id, (SELECT count(*) FROM range(1, 8) e(i) WHERE floor(h * i / 8) <= m) AS band, k, avg(p) AS a FROM cr JOIN (SELECT id, max(m) + 1 AS h FROM cr GROUP BY id) USING (id) GROUP BY ALL)", "ft AS (SELECT band, k, avg(a) AS mu, stddev_pop(a) + 1e-9 AS s FROM bp WHERE id % 10 < 8 GROUP BY band, k)", "SELECT id, round(max(z), 4) AS score FROM (SELECT id, bp.band, avg(abs(a - mu) / s) AS z FROM bp JOIN ft ON bp.band = ft.band AND bp.k = ft.k GROUP BY id, bp.band) GROUP BY id"),
    "roll_shift": _sql(CELLS, CROP, "SELECT id, ((m + 3) % 8)::BIGINT AS m, ((k + 2) % 3)::BIGINT AS k, p FROM cr"),
    "align_crop": _sql(CELLS, CROP, "SELECT id, m::BIGINT AS m, k::BIGINT AS k, p FROM cr"),
    "mahalanobis_diag": _sql(BANK, "SELECT sample_idx, round(sum(pow((v - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 2)), 5) AS score FROM x JOIN mu USING (d) GROUP BY sample_idx"),
    "knn_distance": _sql(BANK, DIST, "SELECT sample_idx, round(avg(dist), 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY round(dist, 9), nb) AS r FROM ds) WHERE r <= 5 GROUP BY sample_idx"),
    "lof": _sql(BANK, DIST, "nn AS (SELECT d.*, row_number() OVER (PARTITION BY d.sample_idx ORDER BY round(dist, 9), nb) AS r FROM ds d JOIN e ON e.sample_idx = d.sample_idx AND e.label = 0 WHERE d.sample_idx <> d.nb)", "ins AS (SELECT * FROM nn WHERE r <= 5)", "kd AS (SELECT sample_idx, max(dist) AS kd FROM ins GROUP BY sample_idx)", "li AS (SELECT ins.sample_idx, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd FROM ins JOIN kd ON kd.sample_idx = ins.nb GROUP BY ins.sample_idx)", "ou AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx ORDER BY round(dist, 9), nb) AS r FROM ds) WHERE r <= 5)", "lo AS (SELECT ou.sample_idx, 1 / (avg(greatest(dist, kd)) + 1e-10) AS lrd, avg(li.lrd) AS nl FROM ou JOIN kd ON kd.sample_idx = ou.nb JOIN li ON li.sample_idx = ou.nb GROUP BY ou.sample_idx)", "SELECT sample_idx, round(nl / lrd, 5) AS score FROM lo"),
    "patch_knn_max": _sql(BANK, "pt AS (SELECT sample_idx * 4 + d // 16 AS pid, sample_idx, label, d % 16 AS d, v FROM x)", "pd AS (SELECT a.pid, b.pid AS nb, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS dist FROM pt a JOIN pt b ON a.d = b.d AND b.label = 0 GROUP BY a.pid, b.pid)", "SELECT pid // 4 AS sample_idx, round(max(s), 5) AS score FROM (SELECT pid, avg(dist) AS s FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY round(dist, 9), nb) AS r FROM pd) WHERE r <= 3 GROUP BY pid) GROUP BY pid // 4"),
}
