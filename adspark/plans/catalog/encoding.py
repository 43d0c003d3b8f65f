"""Encoding queries: fitted on the training part, applied to all rows."""

from adspark import operators as op
from adspark.config import EncodingConfig, TRAIN_LABEL
from adspark.ml import ImpressionEncoder, code_book, standardize
from adspark.ml.encode import LevelEncoderModel, feature_names, is_dominant, top_or_other
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import BAND, DAY, HOD, IMP, SPLIT, stacked_levels
from adspark.plans.feature_build import build_features
from adspark.plans.impressions import CATEGORIES, PLACEHOLDER, impressions
from adspark.sources.scratch import materialize, new_scratch_path
from adspark.sources.writers import save_model
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

SMOOTHING = 25.0
CONFIG = EncodingConfig(
    dichotomize=("r_name",),
    top_k={"c_mktsegment": 3},
    hybrid=("n_name",),
    target_rate=("device_ip",),
)
COLUMNS = ["r_name", "c_mktsegment", "n_name", "device_ip"]


def features(spark, sf):
    """Both subsets of the modelling table, with ``id`` and ``split``."""
    return build_features(impressions(spark, sf), keep=(*CATEGORIES, "device_ip"),
                          placeholder=PLACEHOLDER).features


def train_part(df):
    return df.where(F.col("split") == TRAIN_LABEL)


def _rows(spark, sf):
    return op.add_split(impressions(spark, sf))


def _counts(spark, sf):
    return op.level_counts(train_part(_rows(spark, sf)), COLUMNS, "click")


def dominant(spark, sf):
    return op.dominant_levels(_counts(spark, sf))


def top_k(spark, sf):
    return op.top_levels(_counts(spark, sf), {"c_mktsegment": 3, "n_name": 10})


def target_encoding(spark, sf):
    return rounded(op.target_rates(_counts(spark, sf), SMOOTHING), 9)


def target_encoding_min_size(spark, sf):
    return rounded(op.target_rates(_counts(spark, sf), SMOOTHING, min_category_size=75), 9)


def encode_dichotomy(spark, sf):
    level = op.dominant_levels(_counts(spark, sf)).where("column = 'r_name'").first()["level"]
    return _rows(spark, sf).select("id", is_dominant("r_name", level).alias("r_name_is_dominant"))


def encode_topk_other(spark, sf):
    top = op.top_levels(_counts(spark, sf), {"n_name": 10}).collect()
    return _rows(spark, sf).select(
        "id", top_or_other("n_name", [r["level"] for r in top]).alias("n_name_top"))


def _fitted(spark, sf):
    # fitting and every lookup read the features again, so they are written once
    f = materialize(features(spark, sf), "features")
    return ImpressionEncoder.of(CONFIG, smoothing=SMOOTHING).fit(train_part(f)), f


def encode_hybrid(spark, sf):
    model, f = _fitted(spark, sf)
    return rounded(model.transform(f).select("id", "n_name_is_dominant", "n_name_te"), 9)


def encode_hybrid_bucketed(spark, sf):
    """Rates in buckets of their levels, none broadcast: only the rows are shuffled."""
    model, f = _fitted(spark, sf)
    levels = next(s for s in model.stages if isinstance(s, LevelEncoderModel))
    out = levels.with_bucketed_rates(broadcast_bytes=0).transform(f)
    return rounded(out.select("id", "n_name_is_dominant", "n_name_te"), 9)


def matrix(model, f):
    """One column per entry of the feature vector."""
    x = model.transform(f).select("id", vector_to_array("features").alias("x"))
    width = len(feature_names(model))
    return rounded(x.select("id", *[F.col("x")[i].alias(f"f{i:02d}") for i in range(width)]), 8)


def encoded_matrix(spark, sf):
    return matrix(*_fitted(spark, sf))


def saved_encoder(spark, sf):
    """The matrix of an encoder that was saved and loaded."""
    model, f = _fitted(spark, sf)
    path = new_scratch_path(spark, "encoder")
    save_model(model, path)
    return matrix(PipelineModel.load(path), f)


def scaled_numeric(spark, sf):
    f = features(spark, sf)
    names = ["log_freq_device_id", "log_freq_device_ip"]
    x = standardize(train_part(f), names).transform(f).select(
        "id", vector_to_array("scaled").alias("x"))
    return rounded(x.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate(names)]), 8)


def codes(spark, sf):
    return code_book(impressions(spark, sf), [*CATEGORIES, "device_ip"])


_FIT = f"""
WITH {IMP}, s AS (SELECT *, {SPLIT} AS split FROM imp),
tr AS (SELECT * FROM s WHERE split = 'Entrenamiento'),
cnt AS ({stacked_levels("tr", COLUMNS, "click")}),
rk AS (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, level) AS rank,
         (SUM(pos) OVER (PARTITION BY "column"))::DOUBLE
           / SUM(n) OVER (PARTITION BY "column") AS mean FROM cnt),
te AS (SELECT *, (pos + 25.0::DOUBLE * mean) / (n + 25.0::DOUBLE) AS rate FROM rk),
gm AS (SELECT AVG(click) AS mean FROM tr),
fid AS (SELECT device_id, COUNT(*) AS n FROM tr WHERE device_id <> 0 GROUP BY device_id),
fip AS (SELECT device_ip, COUNT(*) AS n FROM tr GROUP BY device_ip),
lf AS (
  SELECT s.*, ln(CASE WHEN s.device_id = 0 THEN 1 ELSE COALESCE(fid.n, 0) + 1 END) AS l_id,
         ln(COALESCE(fip.n, 0) + 1) AS l_ip
  FROM s LEFT JOIN fid ON s.device_id = fid.device_id
         LEFT JOIN fip ON s.device_ip = fip.device_ip),
sc AS (
  SELECT AVG(l_id) AS m_id, stddev_samp(l_id) AS d_id, AVG(l_ip) AS m_ip,
         stddev_samp(l_ip) AS d_ip FROM lf WHERE split = 'Entrenamiento')
"""
_HYBRID = """
enc AS (
  SELECT lf.*,
    CASE WHEN r_name = (SELECT level FROM te WHERE "column" = 'r_name' AND rank = 1)
         THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r_dom,
    CASE WHEN n_name = (SELECT level FROM te WHERE "column" = 'n_name' AND rank = 1)
         THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS n_dom,
    COALESCE(tn.rate, (SELECT mean FROM gm)) AS n_te,
    COALESCE(ti.rate, (SELECT mean FROM gm)) AS ip_te,
    CASE WHEN c_mktsegment IN
           (SELECT level FROM te WHERE "column" = 'c_mktsegment' AND rank <= 3)
         THEN c_mktsegment ELSE 'Other' END AS seg
  FROM lf LEFT JOIN te tn ON tn."column" = 'n_name' AND tn.level = n_name
          LEFT JOIN te ti ON ti."column" = 'device_ip' AND ti.level = device_ip),
slot AS (
  SELECT level, row_number() OVER (ORDER BY level) - 1 AS i FROM (
    SELECT level FROM te WHERE "column" = 'c_mktsegment' AND rank <= 3
    UNION ALL SELECT 'Other'))
"""


def _matrix_sql():
    raw_sin = f"sin(2 * pi() * {HOD} / 24)"
    raw_cos = f"cos(2 * pi() * {HOD} / 24)"
    entries = ["(l_id - m_id) / d_id", "(l_ip - m_ip) / d_ip", f"CAST({DAY} AS DOUBLE)",
               raw_sin, raw_cos, "r_dom", "n_dom", "n_te", "ip_te"]
    entries += [f"CASE WHEN seg = (SELECT level FROM slot WHERE i = {i}) THEN 1.0 ELSE 0.0 END"
                for i in range(4)]
    entries += [f"CASE WHEN {BAND} = '{b}' THEN 1.0 ELSE 0.0 END"
                for b in ("Madrugada", "Mañana", "Noche", "Tarde")]
    cells = ", ".join(
        f"round(CAST({e} AS DOUBLE), 8) + 0.0 AS f{i:02d}" for i, e in enumerate(entries))
    return _FIT + f", {_HYBRID} SELECT id, {cells} FROM enc, sc"


QUERIES = {
    "dominant": dominant,
    "top_k": top_k,
    "target_encoding": target_encoding,
    "target_encoding_min_size": target_encoding_min_size,
    "encode_dichotomy": encode_dichotomy,
    "encode_topk_other": encode_topk_other,
    "encode_hybrid": encode_hybrid,
    "encode_hybrid_bucketed": encode_hybrid_bucketed,
    "encoded_matrix": encoded_matrix,
    "saved_encoder": saved_encoder,
    "scaled_numeric": scaled_numeric,
    "code_book": codes,
}

ORACLE = {
    "dominant": _FIT + 'SELECT "column", level, n FROM te WHERE rank = 1',
    "top_k": _FIT + """SELECT "column", level, n, CAST(rank AS INTEGER) AS rank FROM te
      WHERE ("column" = 'c_mktsegment' AND rank <= 3) OR ("column" = 'n_name' AND rank <= 10)""",
    "target_encoding": _FIT + 'SELECT "column", level, n, round(rate, 9) AS rate FROM te',
    "target_encoding_min_size": _FIT + """SELECT "column", level, n,
      round(CASE WHEN n < 75 THEN mean ELSE rate END, 9) AS rate FROM te""",
    "encode_dichotomy": _FIT + f", {_HYBRID} SELECT id, r_dom AS r_name_is_dominant FROM enc",
    "encode_topk_other": _FIT + """
      SELECT id, CASE WHEN n_name IN
        (SELECT level FROM te WHERE "column" = 'n_name' AND rank <= 10)
        THEN n_name ELSE 'Other' END AS n_name_top FROM s""",
    **dict.fromkeys(["encode_hybrid", "encode_hybrid_bucketed"], _FIT + f""", {_HYBRID}
      SELECT id, n_dom AS n_name_is_dominant, round(n_te, 9) AS n_name_te FROM enc"""),
    "encoded_matrix": _matrix_sql(),
    "saved_encoder": _matrix_sql(),
    "scaled_numeric": _FIT + """
      SELECT id, round((l_id - m_id) / d_id, 8) AS log_freq_device_id,
             round((l_ip - m_ip) / d_ip, 8) AS log_freq_device_ip FROM lf, sc""",
    "code_book": f"WITH {IMP} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS level, row_number() OVER (ORDER BY {c}) - 1 AS code "
        f"FROM (SELECT DISTINCT {c} FROM imp)" for c in [*CATEGORIES, "device_ip"]),
}

