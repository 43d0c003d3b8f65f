"""Temporal, split and frequency queries."""

from adspark import operators as op
from adspark.functions import day_of_month, time_band
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import BAND, COS, DAY, HOD, IMP, SIN, SPLIT
from adspark.plans.feature_build import build_features
from adspark.plans.impressions import (
    CATEGORIES, PLACEHOLDER, events_as_impressions, impressions,
)
from pyspark.sql import functions as F


def ctr_by_hour(spark, sf):
    """Click rate per hour of day."""
    return rounded(op.rate_by_hour(op.temporal_features(events_as_impressions(spark, sf))))


def _by(column, metric, order=None):
    def run(spark, sf):
        e = events_as_impressions(spark, sf).select(
            "click", day_of_month("hour").alias("day"), time_band("hour").alias("time_band"))
        return rounded(op.metric_by_level(e, column, metric, order=order))
    return run


def overview(spark, sf):
    """Click rate per day and per band."""
    return rounded(op.temporal_overview(op.temporal_features(events_as_impressions(spark, sf))))


def temporal_features(spark, sf):
    return rounded(op.temporal_features(events_as_impressions(spark, sf)), 9)


def device_features(spark, sf):
    return rounded(op.device_features(
        events_as_impressions(spark, sf), placeholder=PLACEHOLDER), 9)


def numeric_features(spark, sf):
    return rounded(op.numeric_features(
        events_as_impressions(spark, sf), placeholder=PLACEHOLDER), 9)


def split_assign(spark, sf):
    e = op.add_split(events_as_impressions(spark, sf))
    return e.select("id", "split")


def split_summary(spark, sf):
    return rounded(op.split_summary(op.add_split(events_as_impressions(spark, sf))))


def split_summary_listed(spark, sf):
    """A null target level, and a listed subset that no row has."""
    rows = op.add_split(events_as_impressions(spark, sf)).withColumn(
        "click", F.when(F.col("id") % 7 != 0, F.col("click")))
    return rounded(op.split_summary(rows, split_labels={
        "Entrenamiento": "train", "Prueba": "test", "Reserva": "spare"}))


def split_rates(spark, sf):
    return op.split_rates(op.add_split(events_as_impressions(spark, sf)))


def _build(spark, sf, **options):
    return build_features(impressions(spark, sf), keep=CATEGORIES, placeholder=PLACEHOLDER,
                          **options)


def freq_device_id(spark, sf):
    return _build(spark, sf).freq_id


def freq_device_ip(spark, sf):
    return _build(spark, sf).freq_ip


def _features(label, **options):
    def run(spark, sf):
        f = _build(spark, sf, **options).features.where(F.col("split") == label).drop("split")
        return rounded(f, 9)
    return run


_METRIC_SQL = {
    "ctr": "round(AVG(click) * 100.0, 6)",
    "clicks": "CAST(SUM(click) AS DOUBLE)",
    "impressions": "CAST(COUNT(*) AS DOUBLE)",
}


def _by_sql(level, metric):
    return (f"WITH {IMP} SELECT {level} AS level, {_METRIC_SQL[metric]} AS value "
            "FROM imp GROUP BY 1")


_FREQ = f"""
WITH {IMP}, s AS (SELECT *, {SPLIT} AS split FROM imp),
fid AS (SELECT device_id, COUNT(*) AS n FROM s
        WHERE split = 'Entrenamiento' AND device_id <> 0 GROUP BY device_id),
fip AS (SELECT device_ip, COUNT(*) AS n FROM s
        WHERE split = 'Entrenamiento' GROUP BY device_ip)
"""


def _features_sql(label):
    return _FREQ + f"""
SELECT s.id, click, {DAY} AS day, {SIN} AS hour_sin, {COS} AS hour_cos, {BAND} AS time_band,
       round(ln(CASE WHEN s.device_id = 0 THEN 1 ELSE COALESCE(fid.n, 0) + 1 END), 9)
         AS log_freq_device_id,
       round(ln(COALESCE(fip.n, 0) + 1), 9) AS log_freq_device_ip,
       c_mktsegment, n_name, r_name
FROM s LEFT JOIN fid ON s.device_id = fid.device_id
       LEFT JOIN fip ON s.device_ip = fip.device_ip
WHERE split = '{label}'"""


_DEVICE = f"""
WITH {IMP}, f AS (
  SELECT id, hour,
         CASE WHEN device_id = 0 THEN 0 ELSE COUNT(*) OVER (PARTITION BY device_id) END
           AS freq_device_id,
         COUNT(*) OVER (PARTITION BY device_ip) AS freq_device_ip
  FROM imp)
"""

QUERIES = {
    "ctr_by_hour": ctr_by_hour,
    "ctr_by_day": _by("day", "ctr"),
    "ctr_by_band": _by("time_band", "ctr", ("Madrugada", "Mañana", "Tarde", "Noche")),
    "clicks_by_day": _by("day", "clicks"),
    "impressions_by_band": _by("time_band", "impressions"),
    "temporal_overview": overview,
    "temporal_features": temporal_features,
    "device_features": device_features,
    "numeric_features": numeric_features,
    "split_assign": split_assign,
    "split_summary": split_summary,
    "split_summary_listed": split_summary_listed,
    "split_rates": split_rates,
    "freq_device_id": freq_device_id,
    "freq_device_ip": freq_device_ip,
    "features_train": _features("Entrenamiento"),
    "features_test": _features("Prueba"),
    # frequencies in buckets of their keys, none broadcast: only the rows are shuffled
    "features_train_bucketed": _features("Entrenamiento", bucketed=True, broadcast_bytes=0),
    "features_test_bucketed": _features("Prueba", bucketed=True, broadcast_bytes=0),
}

ORACLE = {
    "ctr_by_hour": f"""WITH {IMP}
      SELECT {HOD} AS hour, round(AVG(click) * 100.0, 6) AS ctr, COUNT(*) AS n
      FROM imp GROUP BY 1""",
    "ctr_by_day": _by_sql(DAY, "ctr"),
    "ctr_by_band": _by_sql(BAND, "ctr"),
    "clicks_by_day": _by_sql(DAY, "clicks"),
    "impressions_by_band": _by_sql(BAND, "impressions"),
    "temporal_overview": f"""WITH {IMP}, b AS (
        SELECT {BAND} AS band, CASE {BAND} WHEN 'Madrugada' THEN 1 WHEN 'Mañana' THEN 2
               WHEN 'Tarde' THEN 3 ELSE 4 END AS place, click FROM imp)
      SELECT 'day' AS panel, CAST(row_number() OVER (ORDER BY {DAY}) AS INTEGER) AS position,
             CAST({DAY} AS VARCHAR) AS level, round(AVG(click) * 100.0, 6) AS value
      FROM imp GROUP BY {DAY}
      UNION ALL
      SELECT 'band', CAST(row_number() OVER (ORDER BY place) AS INTEGER), band,
             round(AVG(click) * 100.0, 6) FROM b GROUP BY band, place""",
    "temporal_features": f"""WITH {IMP}
      SELECT id, hour AS hour_raw, click, {DAY} AS day, {HOD} AS hour_of_day,
             {SIN} AS hour_sin, {COS} AS hour_cos, {BAND} AS time_band FROM imp""",
    "device_features": _DEVICE + """
      SELECT id, freq_device_id, freq_device_ip,
             round(ln(freq_device_id + 1), 9) AS log_freq_device_id,
             round(ln(freq_device_ip + 1), 9) AS log_freq_device_ip FROM f""",
    "numeric_features": _DEVICE + f"""
      SELECT id, {DAY} AS day, {SIN} AS hour_sin, {COS} AS hour_cos,
             round(ln(freq_device_id + 1), 9) AS log_freq_device_id,
             round(ln(freq_device_ip + 1), 9) AS log_freq_device_ip FROM f""",
    "split_assign": f"WITH {IMP} SELECT id, {SPLIT} AS split FROM imp",
    "split_summary": f"""WITH {IMP}, s AS (SELECT click, {SPLIT} AS split FROM imp),
      g AS (SELECT split, click, COUNT(*) AS n FROM s GROUP BY ALL)
      SELECT split, CAST(click AS VARCHAR) AS level, n,
             round(100.0 * n / SUM(n) OVER (PARTITION BY split), 6) AS pct FROM g
      UNION ALL
      SELECT split, 'Total', COUNT(*), round(100.0 * COUNT(*) / (SELECT COUNT(*) FROM s), 6)
      FROM s GROUP BY split""",
    "split_summary_listed": f"""WITH {IMP}, s AS (
        SELECT CASE WHEN id % 7 <> 0 THEN CAST(click AS VARCHAR) END AS level,
               CASE {SPLIT} WHEN 'Prueba' THEN 'test' ELSE 'train' END AS split FROM imp),
      sub AS (FROM (VALUES ('train'), ('test'), ('spare')) t(split)),
      z AS (SELECT sub.split, COUNT(s.split) AS m FROM sub LEFT JOIN s USING (split) GROUP BY 1),
      c AS (SELECT z.split, l.level, m, (SELECT COUNT(*) FROM s WHERE s.split = z.split
              AND s.level IS NOT DISTINCT FROM l.level) AS n
            FROM z, (SELECT DISTINCT level FROM s) l)
      SELECT split, level, n, round(CASE WHEN m = 0 THEN 0.0 ELSE 100.0 * n / m END, 6) AS pct
      FROM c
      UNION ALL SELECT split, 'Total', m, round(100.0 * m / (SELECT COUNT(*) FROM s), 6) FROM z""",
    "split_rates": f"""WITH {IMP}, s AS (SELECT click, {SPLIT} AS split FROM imp)
      SELECT split, COUNT(*) AS n, round(AVG(click) * 100, 4) AS ctr_pct
      FROM s GROUP BY split""",
    "freq_device_id": _FREQ + "SELECT device_id, n FROM fid",
    "freq_device_ip": _FREQ + "SELECT device_ip, n FROM fip",
    "features_train": _features_sql("Entrenamiento"),
    "features_test": _features_sql("Prueba"),
    "features_train_bucketed": _features_sql("Entrenamiento"),
    "features_test_bucketed": _features_sql("Prueba"),
}
