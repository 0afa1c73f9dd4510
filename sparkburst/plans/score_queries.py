"""Queries over the score bank of ``embeddings``, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ensemble as en
from ..operators import evaluation as ev
from ..operators import resampling as rs
from ..operators.ordered import quantiles
from ..operators.scores import background_split, labelled_vectors, score_bank
from ..sources.stored import stored
from ..sources.tables import label_examples, read_table

WEIGHTS = {"head_energy": 0.1, "l2_centroid": 0.4, "max_abs_z": 0.2, "mean_abs_z": 0.3}


def bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(score_bank(labelled_vectors(read_table(spark, sf_dir, "embeddings"))))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few places and counts to long, for comparison across engines."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c).cast("long").alias(c) if kinds[c] in ("int", "bigint", "smallint") else F.col(c) for c in df.columns])


def _on_bank(f):
    return lambda spark, sf_dir: rounded(f(bank(spark, sf_dir)))


def _scaled_wide(b: DataFrame) -> DataFrame:
    units = en.unit_span(b).groupBy("sample_idx")
    return units.agg(*[F.max(F.when(F.col("method") == m, F.col("unit"))).alias(m) for m in ("l2_centroid", "max_abs_z", "mean_abs_z")])


def _blend(b):
    w = _scaled_wide(b)
    return w.select("sample_idx", en.blend_scores([F.col("l2_centroid"), F.col("max_abs_z"), F.col("mean_abs_z")], [2.0, 1.0, 1.0]).alias("blend"))


def _gate(b):
    return _scaled_wide(b).select("sample_idx", en.reconstruction_gate(F.col("l2_centroid"), F.col("max_abs_z")).alias("gate"))


def _ecdf(spark, sf_dir):
    b = bank(spark, sf_dir)
    split = background_split(b.select("sample_idx", "label").distinct())
    cal = b.join(split.where("part = 'cal'"), "sample_idx", "left_semi")
    return rounded(en.ecdf_normalise(cal, b).select("sample_idx", "method", "ecdf"))


def _split(spark, sf_dir):
    return rounded(background_split(labelled_vectors(read_table(spark, sf_dir, "embeddings")).select("sample_idx", "label")))


def _features(spark, sf_dir):
    v = labelled_vectors(read_table(spark, sf_dir, "embeddings"))
    cells = v.select((F.col("label") > 0).cast("int").alias("y"), F.posexplode("x").alias("feature", "value"))
    return rounded(ev.mann_whitney(cells.select(F.col("feature").cast("string").alias("feature"), F.round("value", 6).alias("value"), "y")).select("feature", "u", "effect", "p_value"), 5)


def _documents(spark, sf_dir):
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    rows = docs.join(labels, "doc_id").select(F.lit("n_chars").alias("method"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("y"))
    return rounded(ev.roc_auc(rows).join(ev.average_precision(rows), "method"))


def _lineitem_quantiles(spark, sf_dir):
    rows = read_table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_extendedprice").alias("score"))
    return rounded(quantiles(rows, ["method"], "score", [0.5, 0.9, 0.99]).select("method", F.col("level"), "q"), 4)


def _discrimination(spark, sf_dir):
    v = labelled_vectors(read_table(spark, sf_dir, "embeddings"))
    x = F.transform("x", lambda value: F.round(value.cast("double"), 6))
    found = rs.feature_discrimination(v.select((F.col("label") > 0).cast("int").alias("y"), x.alias("x")))
    return rounded(found.withColumn("significant", F.col("significant").cast("int")), 5)


QUERIES = {
    "score_bank": lambda s, d: rounded(bank(s, d)),
    "bg_split_md5": _split,
    "fpr_thresholds": _on_bank(ev.rates_at_fpr),
    "zero_fp_threshold": _on_bank(ev.zero_fp),
    "tpr_by_class": _on_bank(ev.rates_by_class),
    "hits_at_fpr": _on_bank(ev.hits_at_fpr),
    "roc_auc": _on_bank(ev.roc_auc),
    "average_precision": _on_bank(ev.average_precision),
    "document_length_auc": _documents,
    "method_summary": _on_bank(ev.method_summary),
    "roc_points": _on_bank(ev.roc_points),
    "score_histogram": _on_bank(ev.histogram),
    "mannwhitney_effect": _features,
    "order_stat_threshold": _on_bank(ev.order_statistic_threshold),
    "price_quantiles": _lineitem_quantiles,
    "minmax_norm": _on_bank(lambda b: en.minmax(b).select("sample_idx", "method", "scaled")),
    "rank_ensemble": _on_bank(en.rank_ensemble),
    "mean_ensemble": _on_bank(en.mean_ensemble),
    "weighted_ensemble": _on_bank(en.weighted_ensemble),
    "topk_ensemble": _on_bank(en.topk_ensemble),
    "rank_ensemble_loo": _on_bank(en.rank_ensemble_loo),
    "mean_ensemble_loo": _on_bank(en.mean_ensemble_loo),
    "weighted_ensemble_loo": _on_bank(en.weighted_ensemble_loo),
    "topk_ensemble_loo": _on_bank(en.topk_ensemble_loo),
    "selection_counts": _on_bank(en.selection_counts),
    "ecdf_normalise": _ecdf,
    "weighted_score": lambda s, d: rounded(en.weighted_score(bank(s, d), WEIGHTS), 8),
    "blend_scores": _on_bank(_blend),
    "recon_gate": _on_bank(_gate),
    "weight_objective": _on_bank(lambda b: en.weight_objective(b, WEIGHTS)),
    "label_examples": lambda s, d: rounded(label_examples(labelled_vectors(read_table(s, d, "embeddings")))),
    "bootstrap_auc": lambda s, d: rs.bootstrap_auc(bank(s, d)),
    "method_report": _on_bank(rs.method_report),
    "feature_discrimination": _discrimination,
}

BANK = """e AS (SELECT vec_id AS sample_idx, CASE label WHEN 8 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS label, embedding FROM embeddings),
x AS (SELECT sample_idx, label, unnest(range(0, len(embedding))) AS d, unnest(embedding)::DOUBLE AS v FROM e),
mu AS (SELECT d, avg(v) AS m, stddev_pop(v) AS s FROM x WHERE label = 0 GROUP BY d),
w AS (SELECT sample_idx, label, round(sqrt(sum((v-m)*(v-m))), 6) AS l2_centroid, round(max(abs(v-m)/(s+1e-9)), 6) AS max_abs_z,
 round(avg(abs(v-m)/(s+1e-9)), 6) AS mean_abs_z, round(sum(CASE WHEN d < 8 THEN v*v ELSE 0 END), 6) AS head_energy FROM x JOIN mu USING (d) GROUP BY sample_idx, label),
b AS (SELECT sample_idx, label, CASE WHEN label > 0 THEN 1 ELSE 0 END AS y, method, score FROM (
 SELECT sample_idx, label, 'l2_centroid' AS method, l2_centroid AS score FROM w UNION ALL SELECT sample_idx, label, 'max_abs_z', max_abs_z FROM w
 UNION ALL SELECT sample_idx, label, 'mean_abs_z', mean_abs_z FROM w UNION ALL SELECT sample_idx, label, 'head_energy', head_energy FROM w))"""

SPLIT = """n AS (SELECT count(*) AS total FROM e WHERE label = 0),
k AS (SELECT sample_idx, row_number() OVER (ORDER BY md5(CAST(sample_idx AS VARCHAR))) - 1 AS r FROM e WHERE label = 0),
split AS (SELECT sample_idx, CASE WHEN r < floor(total*0.8) THEN 'train' WHEN r < floor(total*0.8) + floor(total*0.2) THEN 'cal' ELSE 'rest' END AS part FROM k, n)"""

THR = """thr AS (SELECT method, fpr::DOUBLE AS fpr, CASE fpr WHEN 0.01 THEN t1 WHEN 0.025 THEN t2 WHEN 0.05 THEN t3 ELSE t4 END AS threshold FROM
 (SELECT method, quantile_cont(score, 0.99) AS t1, quantile_cont(score, 0.975) AS t2, quantile_cont(score, 0.95) AS t3, quantile_cont(score, 0.9) AS t4 FROM b WHERE y = 0 GROUP BY method),
 (VALUES (0.01), (0.025), (0.05), (0.10)) f(fpr))"""
AUC = "auc AS (SELECT p.method, sum(CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM b p JOIN b q ON p.method = q.method AND p.y = 1 AND q.y = 0 GROUP BY p.method)"
AP = """g AS (SELECT method, score, sum(y) AS p, count(*) AS n FROM b GROUP BY method, score),
c AS (SELECT method, score, p, sum(p) OVER o AS tp, sum(n) OVER o AS shown, sum(p) OVER (PARTITION BY method) AS pa, sum(n) OVER (PARTITION BY method) AS na FROM g WINDOW o AS (PARTITION BY method ORDER BY score DESC)),
ap AS (SELECT method, sum(p / pa * tp / shown) AS ap FROM c GROUP BY method)"""
SCALED = "sc AS (SELECT sample_idx, label, y, method, score, (score - min(score) OVER m) / (max(score) OVER m - min(score) OVER m + 1e-10) AS scaled FROM b WINDOW m AS (PARTITION BY method))"
LOO = """lo AS (SELECT i.sample_idx, i.y, i.method, i.score, min(j.score) AS lo, max(j.score) AS hi FROM b i JOIN b j ON i.method = j.method AND i.sample_idx <> j.sample_idx GROUP BY i.sample_idx, i.y, i.method, i.score),
ls AS (SELECT sample_idx, y, method, (score - lo) / (hi - lo + 1e-10) AS scaled FROM lo)"""
LOOAUC = """pr AS (SELECT p.method, p.sample_idx AS i, q.sample_idx AS j, CASE WHEN p.score > q.score THEN 1.0 WHEN p.score = q.score THEN 0.5 ELSE 0 END AS c FROM b p JOIN b q ON p.method = q.method AND p.y = 1 AND q.y = 0),
tot AS (SELECT method, sum(c) AS u, count(*) AS n FROM pr GROUP BY method),
own AS (SELECT method, s, sum(c) AS u, count(*) AS n FROM (SELECT method, i AS s, c FROM pr UNION ALL SELECT method, j, c FROM pr) GROUP BY method, s),
la AS (SELECT own.method, own.s AS sample_idx, CASE WHEN tot.n - own.n > 0 THEN (tot.u - own.u) / (tot.n - own.n) ELSE 0.5 END AS auc_loo FROM own JOIN tot ON own.method = tot.method),
pk AS (SELECT method, sample_idx, auc_loo, row_number() OVER (PARTITION BY sample_idx ORDER BY round(auc_loo, 12) DESC, method) AS pick FROM la)"""


def _sql(*parts: str) -> str:
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


UNIT = "un AS (SELECT sample_idx, max(CASE WHEN method = 'l2_centroid' THEN u END) AS a, max(CASE WHEN method = 'max_abs_z' THEN u END) AS c, max(CASE WHEN method = 'mean_abs_z' THEN u END) AS z FROM (SELECT sample_idx, method, CASE WHEN max(score) OVER m > min(score) OVER m THEN (score - min(score) OVER m) / (max(score) OVER m - min(score) OVER m) ELSE 0 END AS u FROM b WINDOW m AS (PARTITION BY method)) GROUP BY sample_idx)"
WSUM = "ws AS (SELECT sample_idx, y, sum(score * CASE method WHEN 'head_energy' THEN 0.1 WHEN 'l2_centroid' THEN 0.4 WHEN 'max_abs_z' THEN 0.2 ELSE 0.3 END) AS ensemble FROM b GROUP BY sample_idx, y)"

#: Rank sums and normal deviates of each dimension.
RANKS = [BANK, "f AS (SELECT d, round(v, 6) AS v, CASE WHEN label > 0 THEN 1 ELSE 0 END AS y FROM x)", "rk AS (SELECT d, v, y, rank() OVER (PARTITION BY d ORDER BY v) + (count(*) OVER (PARTITION BY d, v) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY d, v) AS t FROM f)", "u AS (SELECT d, sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2.0 AS u, sum(y)::DOUBLE AS n1, sum(1 - y)::DOUBLE AS n2, sum(t::DOUBLE * t - 1) AS ties FROM rk GROUP BY d)", "z AS (SELECT d, u, n1, n2, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM u)", "sr AS (SELECT d, u, n1, n2, z, k, z * product_term AS term FROM (SELECT d, u, n1, n2, z, k, exp(k * ln(z * z + 1e-300) - lg) AS product_term FROM z, (SELECT k, sum(CASE WHEN j > 0 THEN ln(2 * j + 1) ELSE 0 END) AS lg FROM range(0, 60) a(k), range(0, 60) c(j) WHERE j <= k GROUP BY k)))"]

ORACLES = {
    "score_bank": _sql(BANK, "SELECT sample_idx, label::BIGINT AS label, y::BIGINT AS y, method, score FROM b"),
    "bg_split_md5": _sql(BANK, SPLIT, "SELECT sample_idx, part FROM split"),
    "fpr_thresholds": _sql(BANK, THR, "SELECT method, fpr, round(threshold, 6) AS threshold, sum(CASE WHEN score > threshold THEN y ELSE 0 END)::BIGINT AS n_detected, sum(y)::BIGINT AS n_total, sum(CASE WHEN score > threshold THEN 1 - y ELSE 0 END)::BIGINT AS n_false, round(sum(CASE WHEN score > threshold THEN y ELSE 0 END)::DOUBLE / sum(y), 6) AS tpr FROM b JOIN thr USING (method) GROUP BY method, fpr, threshold"),
    "zero_fp_threshold": _sql(BANK, "t AS (SELECT method, max(score) AS threshold FROM b WHERE y = 0 GROUP BY method)", "SELECT method, round(threshold, 6) AS threshold, sum(CASE WHEN score > threshold AND y = 1 THEN 1 ELSE 0 END)::BIGINT AS n_detected, sum(y)::BIGINT AS n_total FROM b JOIN t USING (method) GROUP BY method, threshold"),
    "tpr_by_class": _sql(BANK, THR, "SELECT method, label::BIGINT AS label, sum(CASE WHEN score > threshold THEN 1 ELSE 0 END)::BIGINT AS n_detected, count(*)::BIGINT AS n_total, round(avg(CASE WHEN score > threshold THEN 1.0 ELSE 0 END), 6) AS tpr FROM b JOIN thr USING (method) WHERE fpr = 0.01 AND label > 0 GROUP BY method, label"),
    "hits_at_fpr": _sql(BANK, THR, "SELECT method, sum(CASE WHEN score > threshold THEN y ELSE 0 END)::BIGINT AS true_hits, sum(CASE WHEN score > threshold THEN 1 - y ELSE 0 END)::BIGINT AS false_hits FROM b JOIN thr USING (method) WHERE fpr = 0.01 GROUP BY method"),
    "roc_auc": _sql(BANK, AUC, "SELECT method, round(auc, 6) AS auc FROM auc"),
    "average_precision": _sql(BANK, AP, "SELECT method, round(ap, 6) AS ap FROM ap"),
    "document_length_auc": _sql("b AS (SELECT 'n_chars' AS method, n_chars::DOUBLE AS score, quality AS y FROM documents JOIN labels USING (doc_id))", AUC, AP, "SELECT method, round(auc, 6) AS auc, round(ap, 6) AS ap FROM auc JOIN ap USING (method)"),
    "method_summary": _sql(BANK, THR, AUC, AP, "r AS (SELECT method, sum(CASE WHEN fpr = 0.01 AND score > threshold THEN y ELSE 0 END)::DOUBLE / sum(CASE WHEN fpr = 0.01 THEN y ELSE 0 END) AS tpr_1, sum(CASE WHEN fpr = 0.05 AND score > threshold THEN y ELSE 0 END)::DOUBLE / sum(CASE WHEN fpr = 0.05 THEN y ELSE 0 END) AS tpr_5, avg(CASE WHEN fpr = 0.01 AND label = 1 THEN CASE WHEN score > threshold THEN 1.0 ELSE 0 END END) AS tpr_c1, avg(CASE WHEN fpr = 0.01 AND label = 2 THEN CASE WHEN score > threshold THEN 1.0 ELSE 0 END END) AS tpr_c2 FROM b JOIN thr USING (method) GROUP BY method)", "SELECT method, round(auc, 6) AS auc, round(ap, 6) AS ap, round(tpr_1, 6) AS tpr_1, round(tpr_5, 6) AS tpr_5, round(tpr_c1, 6) AS tpr_c1, round(tpr_c2, 6) AS tpr_c2 FROM auc JOIN ap USING (method) JOIN r USING (method)"),
    "roc_points": _sql(BANK, AP, "SELECT method, score AS threshold, round(tp / pa, 6) AS tpr, round((shown - tp) / (na - pa), 6) AS fpr FROM c"),
    "score_histogram": _sql(BANK, "sp AS (SELECT method, min(score) AS lo, max(score) AS hi FROM b GROUP BY method)", "SELECT method, CASE WHEN hi > lo THEN least(floor((score - lo) / (hi - lo) * 20), 19) ELSE 0 END::BIGINT AS bin, y::BIGINT AS y, count(*)::BIGINT AS n FROM b JOIN sp USING (method) GROUP BY ALL"),
    "order_stat_threshold": _sql(BANK, "r AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score DESC) - 1 AS k, count(*) OVER (PARTITION BY method) AS n FROM b WHERE y = 0)", "t AS (SELECT method, score AS threshold FROM r WHERE k = floor(n * 0.01))", "SELECT method, threshold, sum(CASE WHEN score >= threshold THEN y ELSE 0 END)::BIGINT AS n_detected, sum(CASE WHEN score >= threshold THEN 1 - y ELSE 0 END)::BIGINT AS n_false FROM b JOIN t USING (method) GROUP BY method, threshold"),
    "price_quantiles": "WITH q AS (SELECT l_returnflag AS method, quantile_cont(l_extendedprice, 0.5) AS a, quantile_cont(l_extendedprice, 0.9) AS b, quantile_cont(l_extendedprice, 0.99) AS c FROM lineitem GROUP BY l_returnflag) SELECT method, 0.5::DOUBLE AS level, round(a, 4) AS q FROM q UNION ALL SELECT method, 0.9::DOUBLE, round(b, 4) FROM q UNION ALL SELECT method, 0.99::DOUBLE, round(c, 4) FROM q",
    "minmax_norm": _sql(BANK, SCALED, "SELECT sample_idx, method, round(scaled, 6) AS scaled FROM sc"),
    "rank_ensemble": _sql(BANK, "r AS (SELECT sample_idx, method, rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rk FROM b)", "SELECT sample_idx, round(avg(rk), 6) AS ensemble FROM r GROUP BY sample_idx"),
    "mean_ensemble": _sql(BANK, SCALED, "SELECT sample_idx, round(avg(scaled), 6) AS ensemble FROM sc GROUP BY sample_idx"),
    "weighted_ensemble": _sql(BANK, SCALED, AUC, "SELECT sample_idx, round(sum(scaled * auc / s), 6) AS ensemble FROM sc JOIN auc USING (method), (SELECT sum(auc) AS s FROM auc) GROUP BY sample_idx"),
    "topk_ensemble": _sql(BANK, SCALED, AUC, "k AS (SELECT method FROM auc ORDER BY auc DESC, method LIMIT 2)", "SELECT sample_idx, round(avg(scaled), 6) AS ensemble FROM sc WHERE method IN (SELECT method FROM k) GROUP BY sample_idx"),
    "rank_ensemble_loo": _sql(BANK, "r AS (SELECT i.sample_idx, i.method, (sum(CASE WHEN j.score < i.score THEN 1 ELSE 0 END) + (sum(CASE WHEN j.score = i.score THEN 1 ELSE 0 END) + 1) / 2.0) / count(*) AS rk FROM b i JOIN b j ON i.method = j.method GROUP BY i.sample_idx, i.method)", "SELECT sample_idx, round(avg(rk), 6) AS ensemble FROM r GROUP BY sample_idx"),
    "mean_ensemble_loo": _sql(BANK, LOO, "SELECT sample_idx, round(avg(scaled), 6) AS ensemble FROM ls GROUP BY sample_idx"),
    "weighted_ensemble_loo": _sql(BANK, LOO, LOOAUC, "SELECT sample_idx, round(CASE WHEN sum(greatest(auc_loo - 0.5, 0)) < 1e-10 THEN avg(scaled) ELSE sum(scaled * greatest(auc_loo - 0.5, 0)) / sum(greatest(auc_loo - 0.5, 0)) END, 6) AS ensemble FROM ls JOIN la USING (sample_idx, method) GROUP BY sample_idx"),
    "topk_ensemble_loo": _sql(BANK, LOO, LOOAUC, "SELECT sample_idx, round(avg(scaled), 6) AS ensemble FROM ls JOIN pk USING (sample_idx, method) WHERE pick <= 2 GROUP BY sample_idx"),
    "selection_counts": _sql(BANK, LOOAUC, "SELECT method, count(*)::BIGINT AS n FROM pk WHERE pick <= 2 GROUP BY method"),
    "ecdf_normalise": _sql(BANK, SPLIT, "cal AS (SELECT method, score FROM b JOIN split USING (sample_idx) WHERE part = 'cal')", "SELECT b.sample_idx, b.method, round(sum(CASE WHEN cal.score < b.score THEN 1.0 ELSE 0 END) / count(*), 6) AS ecdf FROM b JOIN cal ON b.method = cal.method GROUP BY b.sample_idx, b.method"),
    "weighted_score": _sql(BANK, WSUM, "SELECT sample_idx, round(ensemble, 8) AS ensemble FROM ws"),
    "blend_scores": _sql(BANK, UNIT, "SELECT sample_idx, round((2 * a + c + z) / 4, 6) AS blend FROM un"),
    "recon_gate": _sql(BANK, UNIT, "SELECT sample_idx, round(sqrt(a * c), 6) AS gate FROM un"),
    "weight_objective": _sql(BANK, WSUM, "r AS (SELECT round(ensemble, 9) AS s, y FROM ws)", "t AS (SELECT s AS thr FROM (SELECT s, row_number() OVER (ORDER BY s DESC) - 1 AS k, count(*) OVER () AS n FROM r WHERE y = 0) WHERE k = floor(n * 0.01))", "SELECT round(sum(CASE WHEN s >= thr THEN y ELSE 0 END)::DOUBLE / sum(y), 6) AS tpr, round(sum(CASE WHEN s >= thr THEN y ELSE 0 END)::DOUBLE / sum(y) - 0.08 * (0.1*ln(0.1) + 0.4*ln(0.4) + 0.2*ln(0.2) + 0.3*ln(0.3)) / ln(4), 6) AS objective FROM r, t"),
    "label_examples": _sql(BANK, "SELECT label::BIGINT AS label, min(sample_idx) AS sample_idx FROM e GROUP BY label"),
    "mannwhitney_effect": _sql(*RANKS, "SELECT CAST(d AS VARCHAR) AS feature, round(u, 5) AS u, round(abs(1 - 2 * u / (n1 * n2)), 5) AS effect, round(1 - 2 * exp(-z * z / 2) / 2.5066282746310002 * sum(term), 5) AS p_value FROM sr GROUP BY d, u, n1, n2, z"),
    "feature_discrimination": _sql(*RANKS, "p AS (SELECT d, abs(1 - 2 * u / (n1 * n2)) AS e, 1 - 2 * exp(-z * z / 2) / 2.5066282746310002 * sum(term) AS p FROM sr GROUP BY d, u, n1, n2, z)", "SELECT d AS feature_idx, 'Feature ' || d AS feature_name, round(e, 5) AS effect_size, round(p, 5) AS p_value, CAST(p < 0.05 AS BIGINT) AS significant FROM p"),
}
