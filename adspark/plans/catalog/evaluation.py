"""Classifier evaluation queries; two table columns serve as scores."""

from adspark import operators as op
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import IMP
from adspark.plans.impressions import events_as_impressions
from adspark.sources import as_predictions, stack_scores
from adspark.sources.scratch import new_scratch_path
from adspark.sources.writers import write_predictions
from pyspark.sql import functions as F

THRESHOLDS = {"a": 0.5, "b": 0.3}


def _stacked(spark, sf):
    return stack_scores(events_as_impressions(spark, sf), "click",
                        {"a": "score_a", "b": "score_b"})


def roc_points(spark, sf):
    return rounded(op.roc_points(_stacked(spark, sf), origin=False), 8)


def auc(spark, sf):
    return rounded(op.auc(_stacked(spark, sf)), 8)


def youden(spark, sf):
    return rounded(op.youden(_stacked(spark, sf).where("model = 'a'")).drop("model"), 8)


def youden_table(spark, sf):
    return rounded(op.youden(_stacked(spark, sf)), 8)


def confusion(spark, sf):
    return op.confusion(_stacked(spark, sf), THRESHOLDS)


def metrics_table(spark, sf):
    return rounded(op.metrics_table(_stacked(spark, sf), THRESHOLDS), 8)


def metrics_long(spark, sf):
    return rounded(op.metrics_long(op.metrics_table(_stacked(spark, sf), THRESHOLDS)), 8)


def log_loss(spark, sf):
    return rounded(op.log_loss(_stacked(spark, sf)), 8)


def _pair(spark, sf):
    e = events_as_impressions(spark, sf)
    return op.align_predictions(
        as_predictions(spark, e, "click", "score_a", "id"),
        as_predictions(spark, e, "click", "score_b", "id"))


def delong(spark, sf):
    return rounded(op.delong(_pair(spark, sf), with_p=False), 8)


def delong_p(spark, sf):
    """The p-value with the rest."""
    return rounded(op.delong(_pair(spark, sf)), 8)


def delong_by_position(spark, sf):
    """Two prediction files without identifiers, in as many parts as they like, row by row."""
    rows = events_as_impressions(spark, sf)
    folder, paths = new_scratch_path(spark, "predictions"), []
    for model, parts in (("a", 5), ("b", 3)):
        placed = rows.repartitionByRange(parts, "id").sortWithinPartitions("id")
        paths.append(write_predictions(placed.select(
            "click", F.col(f"score_{model}").alias("prediction")), folder, model))
    return rounded(op.delong(op.align_by_position(spark, *paths), with_p=False), 8)


def failure_counts(spark, sf):
    return op.failure_counts(_stacked(spark, sf), THRESHOLDS)


def failing_cases(spark, sf):
    """One false positive and one false negative of score a."""
    e = events_as_impressions(spark, sf).withColumn("prediction", F.col("score_a"))
    fp = op.draw_cases(e, op.is_false_positive(0.5), 1, seed=42)
    fn = op.draw_cases(e, op.is_false_negative(0.5), 1, seed=43)
    return (fp.withColumn("kind", F.lit("fp")).unionByName(fn.withColumn("kind", F.lit("fn")))
            .select("kind", "id", "click", "hour"))


_PRED = f"""
WITH {IMP}, pred AS (
  SELECT 'a' AS model, click AS target, score_a AS prediction FROM imp
  UNION ALL SELECT 'b', click, score_b FROM imp)
"""
_CURVE = _PRED + """, g AS (
  SELECT model, prediction, SUM(target) AS pos, SUM(1 - target) AS neg
  FROM pred GROUP BY model, prediction),
c AS (
  SELECT model, prediction, pos, neg,
         SUM(pos) OVER (PARTITION BY model ORDER BY prediction DESC) AS tp,
         SUM(neg) OVER (PARTITION BY model ORDER BY prediction DESC) AS fp,
         SUM(pos) OVER (PARTITION BY model) AS p, SUM(neg) OVER (PARTITION BY model) AS n
  FROM g),
j AS (SELECT *, tp::DOUBLE / p AS tpr, fp::DOUBLE / n AS fpr FROM c),
a AS (
  SELECT model, SUM(pos * ((n - fp)::DOUBLE + neg / 2.0)) / (MAX(p)::DOUBLE * MAX(n)) AS auc
  FROM c GROUP BY model),
y AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY tpr - fpr DESC, prediction DESC) AS k
  FROM j)
"""
_YOUDEN = """round(prediction, 8) AS threshold, round(tpr, 8) AS sensitivity,
  round(1.0 - fpr, 8) AS specificity, round(tpr - fpr, 8) AS youden_index,
  CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg"""
_CONF = _CURVE + """, l AS (
  SELECT *, CASE model WHEN 'a' THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS threshold FROM pred),
m AS (
  SELECT model, threshold, COUNT(*) AS n, COUNT(*) FILTER (WHERE target = 1) AS n_pos,
         COUNT(*) FILTER (WHERE target = 0) AS n_neg,
         COUNT(*) FILTER (WHERE target = 1 AND prediction >= threshold) AS tp,
         COUNT(*) FILTER (WHERE target = 0 AND prediction >= threshold) AS fp,
         COUNT(*) FILTER (WHERE target = 1 AND prediction < threshold) AS fn,
         COUNT(*) FILTER (WHERE target = 0 AND prediction < threshold) AS tn
  FROM l GROUP BY model, threshold),
q AS (
  SELECT *, (tp + tn)::DOUBLE / n AS accuracy,
         CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS pr,
         CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS rc FROM m),
w AS (
  SELECT q.*, CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END AS f1, auc
  FROM q JOIN a USING (model))
"""

_DELONG = f"""
      WITH {IMP}, b AS (SELECT id, click, score_a AS s1, score_b AS s2 FROM imp),
      v AS (
        SELECT click,
               rank() OVER (ORDER BY s1) + (COUNT(*) OVER (PARTITION BY s1) - 1) / 2.0 AS t1,
               rank() OVER (ORDER BY s2) + (COUNT(*) OVER (PARTITION BY s2) - 1) / 2.0 AS t2,
               rank() OVER (PARTITION BY click ORDER BY s1)
                 + (COUNT(*) OVER (PARTITION BY click, s1) - 1) / 2.0 AS o1,
               rank() OVER (PARTITION BY click ORDER BY s2)
                 + (COUNT(*) OVER (PARTITION BY click, s2) - 1) / 2.0 AS o2,
               COUNT(*) FILTER (WHERE click = 1) OVER () AS p,
               COUNT(*) FILTER (WHERE click = 0) OVER () AS n
        FROM b),
      u AS (
        SELECT click, CASE WHEN click = 1 THEN (t1 - o1) / n ELSE 1 - (t1 - o1) / p END AS v1,
               CASE WHEN click = 1 THEN (t2 - o2) / n ELSE 1 - (t2 - o2) / p END AS v2 FROM v),
      m AS (
        SELECT click, AVG(v1) AS a1, AVG(v2) AS a2,
               (var_samp(v1) + var_samp(v2) - 2 * covar_samp(v1, v2)) / COUNT(*) AS s
        FROM u GROUP BY click),
      r AS (
        SELECT MAX(a1) FILTER (WHERE click = 1) AS auc_1,
               MAX(a2) FILTER (WHERE click = 1) AS auc_2, SUM(s) AS variance FROM m)"""
_DELONG_ROW = """SELECT round(auc_1, 8) AS auc_1, round(auc_2, 8) AS auc_2,
             round(auc_2 - auc_1, 8) AS delta, round(variance, 8) AS variance,
             round((auc_2 - auc_1) / sqrt(variance), 8) AS z"""

QUERIES = {
    "roc_points": roc_points,
    "auc": auc,
    "youden": youden,
    "youden_table": youden_table,
    "confusion": confusion,
    "metrics_table": metrics_table,
    "metrics_long": metrics_long,
    "log_loss": log_loss,
    "delong": delong,
    "delong_p": delong_p,
    "delong_by_position": delong_by_position,
    "failure_counts": failure_counts,
    "failing_cases": failing_cases,
}

ORACLE = {
    "roc_points": _CURVE + """SELECT model, round(prediction, 8) AS threshold,
      round(fpr, 8) AS fpr, round(tpr, 8) AS tpr FROM j""",
    "auc": _CURVE + "SELECT model, round(auc, 8) AS auc FROM a",
    "youden": _CURVE + f"SELECT {_YOUDEN} FROM y WHERE k = 1 AND model = 'a'",
    "youden_table": _CURVE + f"SELECT model, {_YOUDEN} FROM y WHERE k = 1",
    "confusion": _CONF + "SELECT * FROM m",
    "metrics_table": _CONF + """
      SELECT model, threshold, round(accuracy, 8) AS accuracy, round(pr, 8) AS "precision",
             round(rc, 8) AS recall, round(f1, 8) AS f1, round(auc, 8) AS roc_auc,
             n, n_pos, n_neg, tp, fp, fn, tn FROM w""",
    "metrics_long": _CONF + " UNION ALL ".join(
        f"SELECT model, '{name}' AS metric, round(CAST({expr} AS DOUBLE), 8) AS value FROM w"
        for name, expr in (("threshold", "threshold"), ("accuracy", "accuracy"),
                           ("precision", "pr"), ("recall", "rc"), ("f1", "f1"),
                           ("roc_auc", "auc"))),
    "log_loss": _PRED + """, k AS (
        SELECT *, greatest(2.220446049250313e-16,
                           least(1 - 2.220446049250313e-16, prediction)) AS p FROM pred)
      SELECT model, round(-AVG(CASE WHEN target = 1 THEN ln(p) ELSE ln(1 - p) END), 8)
        AS log_loss FROM k GROUP BY model""",
    **dict.fromkeys(["delong", "delong_by_position"], _DELONG + _DELONG_ROW + " FROM r"),
    # the normal tail by its power series: x^(2k+1) / (1 3 5 ... (2k+1)), summed to 200 terms
    "delong_p": _DELONG + """, z AS (
        SELECT *, abs((auc_2 - auc_1) / sqrt(variance)) AS x FROM r),
      t AS (
        SELECT SUM(exp((2 * k + 1) * ln(x) - (k + 1) * ln(2) - lgamma(k + 1.5)
                       + 0.5 * ln(pi()))) AS area FROM z, range(200) k(k))
      """ + _DELONG_ROW + """,
             round(2 * (0.5 - exp(-x * x / 2) / sqrt(2 * pi()) * area), 8) AS p_value
      FROM z, t""",
    "failure_counts": _CONF + "SELECT model, fp + fn AS n_failures, fp AS n_fp, fn AS n_fn FROM m",
    "failing_cases": f"""WITH {IMP}
      (SELECT 'fp' AS kind, id, click, hour FROM imp WHERE score_a >= 0.5 AND click = 0
       ORDER BY md5(concat(CAST(id AS VARCHAR), '42')) LIMIT 1)
      UNION ALL
      (SELECT 'fn', id, click, hour FROM imp WHERE score_a < 0.5 AND click = 1
       ORDER BY md5(concat(CAST(id AS VARCHAR), '43')) LIMIT 1)""",
}
