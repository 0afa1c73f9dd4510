"""Queries against their SQL in DuckDB, on the smallest tables where those are at hand."""

import math
import os

import duckdb
import pytest

from sparkburst.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = ["score_bank", "bg_split_md5", "fpr_thresholds", "roc_auc", "average_precision", "ecdf_normalise", "topk_ensemble_loo", "budgeted_accumulation", "spectrogram", "band_moments", "band_correlation", "uniform_smooth", "knn_distance", "download_plan", "products_needed", "products_missing", "mannwhitney_effect", "feature_discrimination", "cascade_report", "tt2000_times", "prepared_bank", "case_orders", "case_analysis", "case_comparison", "greedy_zero_fp_order", "greedy_after_tax"]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    return round(float(value), 9) + 0.0 if isinstance(value, float) else str(value)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "events", "lineitem", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.execute(registry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
