"""Queries over plans, contrastive batches, probes and whole pipelines, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import kernels as ke
from ..operators import networks as nw
from ..operators import training as tr
from ..operators.contrastive import batch_losses
from ..operators.feature_bank import augment, augmented_features, feature_bank, prepare_bank, specs_from_cells
from ..operators.probes import out_of_fold
from ..operators.scores import labelled_vectors
from ..sources.products import missing_products, plan_of_times, range_of_times, with_address
from ..sources.tables import read_table
from . import learning, robust
from .score_queries import BANK, _sql, rounded
from .signal_queries import cells


def _vectors(spark, sf_dir):
    return labelled_vectors(read_table(spark, sf_dir, "embeddings"))


def _losses(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    batch = F.floor(F.col("sample_idx") / 16)
    rows = v.select(batch.alias("batch"), F.pmod("sample_idx", F.lit(16)).alias("i"), "x")
    return batch_losses(rows, 0.5)


def _plan(spark, sf_dir):
    return range_of_times(read_table(spark, sf_dir, "events"), "dvac12").withColumn("day", F.col("day").cast("string"))


#: An address with all its parts.
TEMPLATE = "https://products.invalid/{kind}/{year}/{month}/{day}/{hour}/{name}"


def _needed(spark, sf_dir):
    """Products that hold click events, with their addresses."""
    clicks = read_table(spark, sf_dir, "events").where("event_type = 'click'")
    return with_address(plan_of_times(clicks, "vac12"), TEMPLATE).withColumn("day", F.col("day").cast("string"))


def _missing(spark, sf_dir):
    """Products of the events' days in which no purchase happened."""
    events = read_table(spark, sf_dir, "events")
    present = plan_of_times(events.where("event_type = 'purchase'"), "dvac12").select("name")
    return missing_products(range_of_times(events, "dvac12"), present).select("name", F.col("day").cast("string").alias("day"), "hour")


#: Generations of the weight search in the registered queries (the operator's default is 500).
QUERY_ROUNDS = 40


def _as_cells(vectors):
    """Vectors of 64 values as spectrograms of 8 x 8 cells."""
    return vectors.select(F.col("sample_idx").alias("id"), F.posexplode("x").alias("d", "p")).select("id", F.floor(F.col("d") / 8).cast("int").alias("m"), F.pmod("d", F.lit(8)).cast("int").alias("k"), "p")


def _specs(spark, sf_dir):
    return specs_from_cells(cells(spark, sf_dir))


def _vector_specs(spark, sf_dir):
    return learning.as_specs(_as_cells(_vectors(spark, sf_dir)))


def _prepared(spark, sf_dir):
    """Cells of the vectors' spectrograms, scaled by the background's."""
    noise = _vectors(spark, sf_dir).where("label = 0")
    bank, _, _ = prepare_bank(_vector_specs(spark, sf_dir), noise, 8, 8)
    lines = bank.select("sample_idx", F.posexplode("spec").alias("m", "line"))
    return rounded(lines.select("sample_idx", "m", F.posexplode("line").alias("k", "p")), 5)


def _network(network):
    """Scores of all vectors by a network of the background."""
    return lambda spark, sf_dir: learning.network_scores(_vectors(spark, sf_dir), network).select("sample_idx", F.round("score", 6).alias("score"))


def _probe(kind):
    def run(spark, sf_dir):
        v = _vectors(spark, sf_dir).withColumn("y", (F.col("label") > 0).cast("int"))
        scored = out_of_fold(v, kind).withColumn("method", F.lit(kind)).withColumn("score", F.round("score", 9))
        return ev.roc_auc(scored).join(ev.average_precision(scored), "method")

    return run


QUERIES = {
    "download_plan": _plan,
    "products_needed": _needed,
    "products_missing": _missing,
    "info_nce_loss": lambda s, d: rounded(_losses(s, d).select("batch", "info_nce")),
    "contrastive_loss": lambda s, d: rounded(_losses(s, d).select("batch", "contrastive")),
    "feature_bank": lambda s, d: feature_bank(_specs(s, d)),
    "prepared_bank": _prepared,
    "augment_bank": lambda s, d: augment(_specs(s, d)),
    "augmented_features": lambda s, d: augmented_features(_vector_specs(s, d)),
    "autoencoder_scores": _network(nw.Autoencoder(64)),
    "autoencoder_loo": lambda s, d: tr.leave_one_out(_vectors(s, d), nw.Autoencoder(64), learning.QUERY_TRAINING).select("sample_idx", F.round("score", 6).alias("score")),
    "vae_scores": _network(nw.VariationalAutoencoder(64)),
    "flow_scores": _network(nw.CouplingFlow(64)),
    "contrastive_codes": lambda s, d: learning.contrastive_codes(_vectors(s, d), (8, 8), tr.Training(epochs=40)).select("sample_idx", F.round(F.aggregate("code", F.lit(0.0), lambda a, v: a + v * v), 4).alias("size")),
    "one_class_svm": lambda s, d: ke.one_class_svm(_vectors(s, d)).withColumn("score", F.round("score", 5)),
    "support_vector": lambda s, d: learning.svm_report(_vectors(s, d), lambda scored: ev.roc_auc(scored).join(ev.average_precision(scored), "method")),
    "physics_loo": lambda s, d: learning.physics_bank(_vector_specs(s, d), _vectors(s, d).select("sample_idx", "label")).withColumn("score", F.round("score", 6)),
    "embedding_loo": lambda s, d: learning.embedding_bank(_vectors(s, d), _vector_specs(s, d)).withColumn("score", F.round("score", 6)),
    "classical_workflow": lambda s, d: rounded(learning.classical_workflow(_vector_specs(s, d), _vectors(s, d).select("sample_idx", "label"))),
    "linear_probe": _probe("logistic"),
    "random_forest": _probe("forest"),
    "gbt_meta": _probe("boosted"),
    "robust_pipeline": lambda s, d: robust.fit(_vectors(s, d), 0.05, _as_cells(_vectors(s, d)), QUERY_ROUNDS).report,
    "robust_predict": lambda s, d: robust.predict(robust.fit(_vectors(s, d), 0.05, rounds=QUERY_ROUNDS), _vectors(s, d), "conservative"),
    "embedding_workflow": lambda s, d: rounded(robust.embedding_workflow(_vectors(s, d))),
    "loo_workflow": lambda s, d: robust.loo_workflow(_vectors(s, d)),
}

LOSS = """u AS (SELECT sample_idx // 16 AS batch, sample_idx % 16 AS i, d, v / sqrt(sum(v * v) OVER (PARTITION BY sample_idx)) AS v FROM x),
s AS (SELECT a.batch, a.i, b.i AS j, sum(a.v * b.v) / 0.5 AS s FROM u a JOIN u b ON a.batch = b.batch AND a.d = b.d GROUP BY a.batch, a.i, b.i),
l AS (SELECT batch, i, ln(sum(CASE WHEN i <> j THEN exp(s) ELSE 0 END)) AS n, ln(sum(exp(s))) AS c, max(CASE WHEN j = xor(i, 1) THEN s END) AS p FROM s GROUP BY batch, i)"""

RANGE = """r AS (SELECT strftime(day, '%Y-%m-%d') AS day, hour, 'dvac12_' || strftime(day, '%Y%m%d') || hour || '.cdf' AS name
FROM (SELECT unnest(generate_series(CAST(min(ts) AS DATE), CAST(max(ts) AS DATE), INTERVAL 1 DAY)) AS day FROM events), (VALUES ('00'), ('06'), ('12'), ('18')) h(hour))"""

ORACLES = {
    "download_plan": _sql(RANGE, "SELECT 'dvac12' AS kind, day, hour, name FROM r"),
    "products_needed": _sql(
        "n AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y/%m/%d/') AS p, strftime(ts, '%Y%m%d') AS d, lpad(CAST(hour(ts) // 6 * 6 AS VARCHAR), 2, '0') AS hour FROM events WHERE event_type = 'click' AND ts IS NOT NULL)",
        "SELECT 'vac12' AS kind, day, hour, 'vac12_' || d || hour || '.cdf' AS name, 'https://products.invalid/vac12/' || p || hour || '/vac12_' || d || hour || '.cdf' AS url FROM n",
    ),
    "products_missing": _sql(RANGE, "SELECT name, day, hour FROM r WHERE NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND strftime(ts, '%Y-%m-%d') = r.day AND hour(ts) // 6 = CAST(r.hour AS INT) // 6)"),
    "prepared_bank": _sql(BANK, "ns AS (SELECT avg(v) AS mean, stddev_samp(v) + 1e-6 AS std FROM x WHERE label = 0)", "SELECT sample_idx, d // 8 AS m, d % 8 AS k, round((v - mean) / std, 5) AS p FROM x, ns"),
    "info_nce_loss": _sql(BANK, LOSS, "SELECT batch, round(avg(n - p), 6) AS info_nce FROM l GROUP BY batch"),
    "contrastive_loss": _sql(BANK, LOSS, "SELECT batch, round(avg(c - p), 6) AS contrastive FROM l GROUP BY batch"),
}
