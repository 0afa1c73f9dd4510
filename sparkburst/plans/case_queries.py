"""Queries over detector combinations, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases
from ..operators import evaluation as ev
from ..sources.stored import stored
from ..sources.tables import read_table
from .score_queries import AP, AUC, BANK, THR, _sql, bank, rounded

ORDERS = [("fixed", 0, "l2_centroid"), ("fixed", 1, "max_abs_z"), ("fixed", 2, "mean_abs_z"), ("reverse", 0, "mean_abs_z"), ("reverse", 1, "head_energy")]
ORDER = ["l2_centroid", "mean_abs_z", "max_abs_z", "head_energy"]
METHODS = ["head_energy", "l2_centroid", "max_abs_z", "mean_abs_z"]


def _orders(spark):
    return spark.createDataFrame(ORDERS, "case string, step int, method string")


def _with_orders(f):
    return lambda spark, sf_dir: rounded(f(bank(spark, sf_dir), _orders(spark)))


#: Measures of an order line as methods; a line is an anomaly if one of three is at its greatest value.
MEASURES = ["l_tax", "l_extendedprice", "l_quantity", "l_discount"]


def _order_lines(spark, sf_dir):
    """A score bank with hits above all background: lines of 50 pieces, 10 % discount or 8 % tax are anomalies."""
    lines = read_table(spark, sf_dir, "lineitem")
    odd = (F.col("l_quantity") >= 50) | (F.col("l_discount") >= 0.1) | (F.col("l_tax") >= 0.08)
    scores = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("score")) for m in MEASURES]))
    rows = lines.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("sample_idx"), odd.cast("int").alias("y"), scores.alias("s"))
    return stored(rows.select("sample_idx", "y", "s.method", "s.score"))


def _greedy(spark, sf_dir):
    order = cases.greedy_order(_order_lines(spark, sf_dir), MEASURES)
    return rounded(spark.createDataFrame(list(enumerate(order)), "step int, method string"))


def _greedy_after(spark, sf_dir):
    """The greedy order after the tax at a rate of 5 %."""
    order = cases.greedy_order(_order_lines(spark, sf_dir), MEASURES, MEASURES[:1], first_fpr=0.05)
    return rounded(spark.createDataFrame(list(enumerate(order)), "step int, method string"))


def _case_analysis(b):
    return rounded(cases.default_case_analysis(b, ev.method_summary(b).withColumn("auc", F.round("auc", 9))).comparison)


QUERIES = {
    "budgeted_accumulation": _with_orders(cases.accumulation),
    "detector_votes": _with_orders(cases.detector_votes),
    "case_scores": _with_orders(cases.case_scores),
    "case_comparison": _with_orders(cases.compare_cases),
    "detection_matrix": _with_orders(lambda b, o: cases.detection_matrix(cases.detector_votes(b, o), METHODS)),
    "case_orders": lambda s, d: rounded(cases.case_orders(ev.method_summary(bank(s, d)).withColumn("auc", F.round("auc", 9)))),
    "cascade_detection": lambda s, d: rounded(cases.cascade(bank(s, d), ORDER, 0.05)),
    "cascade_report": lambda s, d: rounded(cases.cascade_report(bank(s, d), 0.02).withColumn("skipped", F.col("skipped").cast("int"))),
    "case_analysis": lambda s, d: _case_analysis(bank(s, d)),
    "greedy_zero_fp_order": _greedy,
    "greedy_after_tax": _greedy_after,
}

O = "o AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', {s}, '{m}')" for c, s, m in ORDERS) + ") v(kase, step, method))"
HITS = "top AS (SELECT method, max(score) AS top FROM b WHERE y = 0 GROUP BY method),\nh AS (SELECT o.kase, o.step, b.method, sample_idx, label, y FROM b JOIN o USING (method) JOIN top USING (method) JOIN thr ON thr.method = b.method AND thr.fpr = 0.01 WHERE score > CASE WHEN step = 0 THEN threshold ELSE top END)"
ACC = """f AS (SELECT h.*, CASE WHEN step = min(step) OVER (PARTITION BY kase, sample_idx) THEN 1 ELSE 0 END AS fresh FROM h),
s AS (SELECT kase, step, sum(y) AS hits, sum(y * fresh) AS new_hits, sum((1 - y) * fresh) AS fp FROM f GROUP BY kase, step),
acc AS (SELECT o.kase, o.step, o.method, coalesce(hits, 0) AS hits, coalesce(new_hits, 0) AS new_hits, sum(coalesce(new_hits, 0)) OVER w AS recovered, sum(coalesce(fp, 0)) OVER w AS union_fp FROM o LEFT JOIN s USING (kase, step) WINDOW w AS (PARTITION BY o.kase ORDER BY o.step))"""
VOTES = "v AS (SELECT kase, sample_idx, label, count(*) AS votes, string_agg(method, ', ' ORDER BY step) AS methods FROM h WHERE y = 1 GROUP BY kase, sample_idx, label)"


def _cascade_sql(order, far):
    parts = [f"wide AS (SELECT sample_idx, y, {', '.join(f'''max(CASE WHEN method = '{m}' THEN score END) AS s{i}''' for i, m in enumerate(order))} FROM b GROUP BY sample_idx, y)", "st0 AS (SELECT *, false AS f FROM wide)", f"bud AS (SELECT floor({far} * count(*)) AS n FROM wide WHERE y = 0)"]
    for i, m in enumerate(order):
        parts.append(f"t{i} AS (SELECT CASE WHEN max(k) IS NULL THEN NULL ELSE min(s{i}) END AS t FROM (SELECT s{i}, row_number() OVER (ORDER BY s{i} DESC) AS k FROM st{i} WHERE y = 0 AND NOT f), bud WHERE k <= bud.n - (SELECT coalesce(sum(CASE WHEN f AND y = 0 THEN 1 ELSE 0 END), 0) FROM st{i}))")
        parts.append(f"r{i} AS (SELECT {i}::BIGINT AS step, '{m}' AS method, (SELECT t FROM t{i}) AS threshold, sum(CASE WHEN NOT f AND s{i} >= (SELECT t FROM t{i}) THEN y ELSE 0 END)::BIGINT AS new_anomalies, sum(CASE WHEN NOT f AND s{i} >= (SELECT t FROM t{i}) THEN 1 - y ELSE 0 END)::BIGINT AS new_background FROM st{i})")
        parts.append(f"st{i + 1} AS (SELECT sample_idx, y, {', '.join(f's{j}' for j in range(len(order)))}, f OR coalesce(s{i} >= (SELECT t FROM t{i}), false) AS f FROM st{i})")
    return _sql(BANK, *parts, " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(len(order))))


def _cascade_report_sql(n, far):
    """As above with the order taken from what each method finds alone at the place floor(far n) + 1."""
    parts = [
        f"q AS (SELECT method, score, row_number() OVER (PARTITION BY method ORDER BY score DESC) AS k, floor({far} * count(*) OVER (PARTITION BY method)) AS cut FROM b WHERE y = 0)",
        "od AS (SELECT b.method, row_number() OVER (ORDER BY sum(CASE WHEN b.score >= q.score THEN y ELSE 0 END) DESC, b.method) - 1 AS step FROM b JOIN q ON b.method = q.method AND q.k = q.cut + 1 GROUP BY b.method)",
        f"wide AS (SELECT sample_idx, y, {', '.join(f'max(CASE WHEN step = {i} THEN score END) AS s{i}' for i in range(n))} FROM b JOIN od USING (method) GROUP BY sample_idx, y)",
        f"bud AS (SELECT floor({far} * count(*)) AS n FROM wide WHERE y = 0)",
        "st0 AS (SELECT *, false AS f FROM wide)",
    ]
    for i in range(n):
        parts.append(f"t{i} AS (SELECT min(s{i}) AS t FROM (SELECT s{i}, row_number() OVER (ORDER BY s{i} DESC) AS k FROM st{i} WHERE y = 0 AND NOT f), bud WHERE k <= bud.n - (SELECT count(*) FROM st{i} WHERE f AND y = 0))")
        parts.append(f"r{i} AS (SELECT {i}::BIGINT AS step, (SELECT t FROM t{i}) AS threshold, count(*) FILTER (NOT f AND y = 1 AND s{i} >= (SELECT t FROM t{i})) AS new_anomalies, count(*) FILTER (NOT f AND y = 0 AND s{i} >= (SELECT t FROM t{i})) AS new_background FROM st{i})")
        parts.append(f"st{i + 1} AS (SELECT * EXCLUDE (f), f OR coalesce(s{i} >= (SELECT t FROM t{i}), false) AS f FROM st{i})")
    parts.append("r AS (" + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(n)) + ")")
    parts.append("c AS (SELECT *, (sum(new_anomalies) OVER w)::BIGINT AS cum_anomalies, (sum(new_background) OVER w)::BIGINT AS cum_background FROM r JOIN od USING (step) WINDOW w AS (ORDER BY step))")
    total = "(SELECT count(*) FROM wide WHERE y = {})"
    return _sql(BANK, *parts, f"SELECT step, method, threshold, new_anomalies, new_background, cum_anomalies, cum_background, round(cum_anomalies / {total.format(1)}, 6) AS tpr, round(cum_background / {total.format(0)}, 6) AS far, CAST(threshold IS NULL AS BIGINT) AS skipped FROM c")


def _greedy_sql(measures, first_fpr=None):
    """Steps unrolled: each takes the method with most new hits, then most hits, then the earliest in the list.

    With a rate the first method is given, and has seen what lies above that rate's threshold.
    """
    parts = [
        "lb AS (SELECT l_orderkey * 8 + l_linenumber AS sample_idx, l_quantity >= 50 OR l_discount >= 0.1 OR l_tax >= 0.08 AS y, " + ", ".join(measures) + " FROM lineitem)",
        "lm AS (" + " UNION ALL ".join(f"SELECT sample_idx, y, '{m}' AS method, {i} AS place, {m} AS score FROM lb" for i, m in enumerate(measures)) + ")",
        "lt AS (SELECT method, max(score) AS top FROM lm WHERE NOT y GROUP BY method)",
        "hit AS (SELECT sample_idx, method, place FROM lm JOIN lt USING (method) WHERE y AND score > top)",
    ]
    if first_fpr is None:
        parts.append("early AS (SELECT sample_idx FROM hit WHERE false)")
    else:
        parts.append(f"early AS (SELECT sample_idx FROM lb WHERE y AND {measures[0]} > (SELECT quantile_cont({measures[0]}, {1 - first_fpr}) FROM lb WHERE NOT y))")
        parts.append(f"k0 AS (SELECT 0::BIGINT AS step, '{measures[0]}' AS method)")
    for i in range(first_fpr is not None, len(measures)):
        taken = " UNION ALL ".join(f"SELECT method FROM k{j}" for j in range(i)) or "SELECT NULL AS method WHERE false"
        parts.append(f"k{i} AS (SELECT {i}::BIGINT AS step, method FROM (SELECT method, place, count(*) AS hits, sum(CASE WHEN sample_idx IN (SELECT sample_idx FROM hit WHERE method IN ({taken}) UNION ALL FROM early) THEN 0 ELSE 1 END) AS fresh FROM hit WHERE method NOT IN ({taken}) GROUP BY method, place) WHERE fresh > 0 ORDER BY fresh DESC, hits DESC, place LIMIT 1)")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(measures)))


COMPARED = """SELECT kase AS "case", string_agg(method, ' -> ' ORDER BY step) AS methods, count(*)::BIGINT AS n_methods, max(recovered)::BIGINT AS recovered, max(t.total)::BIGINT AS total, round(max(recovered)::DOUBLE / max(t.total), 6) AS coverage, max(union_fp)::BIGINT AS union_fp FROM acc, (SELECT count(DISTINCT sample_idx) AS total FROM b WHERE y = 1) t GROUP BY kase"""
RANKED = [
    "t1 AS (SELECT method, sum(CASE WHEN score > threshold THEN y ELSE 0 END)::DOUBLE / sum(y) AS tpr FROM b JOIN thr USING (method) WHERE fpr = 0.01 GROUP BY method)",
    "r AS (SELECT method, row_number() OVER (ORDER BY round(auc, 9) DESC, method) - 1 AS a, row_number() OVER (ORDER BY tpr DESC, round(auc, 9) DESC, method) - 1 AS q FROM auc JOIN t1 USING (method))",
    "o AS (SELECT 'top AUC' AS kase, a::BIGINT AS step, method FROM r WHERE a < 6 UNION ALL SELECT 'top rate at 1 %', q::BIGINT, method FROM r WHERE q < 6 AND (SELECT string_agg(method, '>' ORDER BY a) FROM r WHERE a < 6) <> (SELECT string_agg(method, '>' ORDER BY q) FROM r WHERE q < 6))",
]

ORACLES = {
    "greedy_zero_fp_order": _greedy_sql(MEASURES),
    "budgeted_accumulation": _sql(BANK, THR, O, HITS, ACC, 'SELECT kase AS "case", step::BIGINT AS step, method, hits::BIGINT AS hits, new_hits::BIGINT AS new_hits, recovered::BIGINT AS recovered, union_fp::BIGINT AS union_fp FROM acc'),
    "detector_votes": _sql(BANK, THR, O, HITS, VOTES, 'SELECT kase AS "case", sample_idx, label::BIGINT AS label, votes, methods FROM v'),
    "case_scores": _sql(BANK, THR, O, HITS, "u AS (SELECT sample_idx, method, CASE WHEN max(score) OVER m > min(score) OVER m THEN (score - min(score) OVER m) / (max(score) OVER m - min(score) OVER m) ELSE 0 END AS u FROM b WINDOW m AS (PARTITION BY method))", "sf AS (SELECT kase, sample_idx, avg(u) AS soft FROM u JOIN o USING (method) GROUP BY kase, sample_idx)", "vt AS (SELECT kase, sample_idx, count(*) AS votes FROM h GROUP BY kase, sample_idx)", 'SELECT kase AS "case", sample_idx, coalesce(votes, 0)::BIGINT AS votes, round(soft, 6) AS soft_score FROM sf LEFT JOIN vt USING (kase, sample_idx)'),
    "case_comparison": _sql(BANK, THR, O, HITS, ACC, COMPARED),
    "detection_matrix": _sql(BANK, THR, O, HITS, 'SELECT kase AS "case", sample_idx, ' + ", ".join(f"max(CASE WHEN method = '{m}' THEN 1 ELSE 0 END)::BIGINT AS {m}" for m in METHODS) + " FROM h WHERE y = 1 GROUP BY kase, sample_idx"),
    "case_orders": _sql(BANK, THR, AUC, *RANKED, 'SELECT kase AS "case", step, method FROM o'),
    "case_analysis": _sql(BANK, THR, AUC, *RANKED, HITS, ACC, COMPARED),
    "greedy_after_tax": _greedy_sql(MEASURES, 0.05),
    "cascade_detection": _cascade_sql(ORDER, 0.05),
    "cascade_report": _cascade_report_sql(len(ORDER), 0.02),
}
