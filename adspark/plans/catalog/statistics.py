"""Association and rank correlation queries."""

from adspark import operators as op
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import IMP, LINES, stacked_levels
from adspark.plans.impressions import PLACEHOLDER, events_as_impressions, sold_lines

# an even number of degrees of freedom each, so that SQL can state the p-value
TESTED = ["l_linenumber", "p_brand", "o_orderstatus", "o_orderpriority"]
RANKED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_retailprice"]
NUMERIC = ["day", "hour_sin", "hour_cos", "log_freq_device_id", "log_freq_device_ip"]


def contingency(spark, sf):
    return op.contingency(sold_lines(spark, sf), TESTED, "returned")


def _association(**options):
    def run(spark, sf):
        return rounded(op.association(
            sold_lines(spark, sf), TESTED, "returned", **options), 6)
    return run


def _spearman(ties):
    def run(spark, sf):
        return rounded(op.rank_correlation(
            sold_lines(spark, sf), RANKED, ties, spread_by=["l_orderkey", "l_linenumber"]))
    return run


def spearman_numeric(spark, sf):
    """The default use: the five numeric model features."""
    f = op.numeric_features(events_as_impressions(spark, sf), placeholder=PLACEHOLDER)
    # the cyclic columns are rounded so that both engines see the same ties
    return rounded(op.rank_correlation(rounded(f, 9), NUMERIC, spread_by=["id"]))


_TESTS = f"""
WITH {LINES}, t AS ({stacked_levels("lines", TESTED, "returned")}),
x AS (
  SELECT *, n - pos AS n0, pos AS n1,
         SUM(n) OVER w AS nn, SUM(pos) OVER w AS c1, SUM(n - pos) OVER w AS c0,
         COUNT(*) OVER w AS levels
  FROM t WINDOW w AS (PARTITION BY "column")),
e AS (SELECT *, n::DOUBLE * c0 / nn AS e0, n::DOUBLE * c1 / nn AS e1 FROM x),
s AS (
  SELECT "column", MAX(levels) - 1 AS dof,
         SUM((n0 - e0) * (n0 - e0) / e0 + (n1 - e1) * (n1 - e1) / e1) AS chi2,
         MAX(nn)::DOUBLE AS nn, MIN(least(e0, e1)) AS min_expected,
         SUM((e0 < 5)::INT + (e1 < 5)::INT)::DOUBLE / (COUNT(*) * 2) AS frac_below_5
  FROM e GROUP BY "column"),
p AS (
  SELECT s."column", dof, chi2, sqrt(chi2 / nn) AS cramers_v, min_expected, frac_below_5,
         min_expected >= 1 AND frac_below_5 <= 0.2 AS assumption_ok,
         (SELECT SUM(exp(-s.chi2 / 2 + i * ln(s.chi2 / 2) - lgamma(i + 1)))
          FROM range(64) r(i) WHERE i < s.dof // 2) AS p_value
  FROM s)
"""
_COLS = """"column", dof, round(chi2, 6) AS chi2, round(p_value, 6) AS p_value,
  round(cramers_v, 6) AS cramers_v, round(min_expected, 6) AS min_expected,
  round(frac_below_5, 6) AS frac_below_5, assumption_ok"""


def _spearman_sql(ties, source, columns, pre):
    if ties == "min":
        ranks = ", ".join(
            f"rank() OVER (ORDER BY {c}) AS r{i}" for i, c in enumerate(columns))
    else:
        ranks = ", ".join(
            f"rank() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r{i}"
            for i, c in enumerate(columns))
    cells = " UNION ALL ".join(
        f"SELECT '{columns[i]}' AS col_i, '{columns[j]}' AS col_j, "
        f"round(corr(r{i}, r{j}), 6) AS rho FROM ranked"
        for i in range(len(columns)) for j in range(i + 1))
    return f"WITH {pre}, ranked AS (SELECT {ranks} FROM {source}) {cells}"


_NUM = f"""{IMP}, f AS (
  SELECT CAST(hour // 100 % 100 AS INTEGER) AS day,
         round(sin(2 * pi() * (hour % 100) / 24), 9) + 0.0 AS hour_sin,
         round(cos(2 * pi() * (hour % 100) / 24), 9) + 0.0 AS hour_cos,
         ln(CASE WHEN device_id = 0 THEN 1
                 ELSE COUNT(*) OVER (PARTITION BY device_id) + 1 END) AS log_freq_device_id,
         ln(COUNT(*) OVER (PARTITION BY device_ip) + 1) AS log_freq_device_ip
  FROM imp)"""

QUERIES = {
    "contingency": contingency,
    "association": _association(alpha=0.999),
    "association_bonferroni": _association(alpha=0.999, p_adjust_method="bonferroni"),
    "association_holm": _association(alpha=0.999, p_adjust_method="holm"),
    "association_flagged": _association(min_expected=1e9, min_effect_size=0.5),
    # no expected count is high enough: all four rows stay, with their adjusted p
    "association_bonferroni_all": _association(p_adjust_method="bonferroni", min_expected=1e9),
    "association_holm_all": _association(p_adjust_method="holm", min_expected=1e9),
    "association_hidden": _association(alpha=0.999, min_expected=1000, hide_invalid=True),
    "spearman_minrank": _spearman("min"),
    "spearman_average": _spearman("average"),
    "spearman_numeric": spearman_numeric,
}

ORACLE = {
    "contingency": f"""WITH {LINES}, t AS ({stacked_levels("lines", TESTED, "returned")})
      SELECT "column", level, n - pos AS n0, pos AS n1 FROM t""",
    "association": _TESTS + f"SELECT {_COLS} FROM p WHERE p_value < 0.999 OR NOT assumption_ok",
    "association_bonferroni": _TESTS + f""", a AS (
        SELECT *, least(p_value * COUNT(*) OVER (), 1.0) AS p_adjusted FROM p)
      SELECT {_COLS}, round(p_adjusted, 6) AS p_adjusted FROM a
      WHERE p_adjusted < 0.999 OR NOT assumption_ok""",
    "association_holm": _TESTS + f""", a AS (
        SELECT *, (COUNT(*) OVER () - row_number() OVER (ORDER BY p_value) + 1) * p_value AS adj
        FROM p), h AS (
        SELECT *, least(MAX(adj) OVER (ORDER BY p_value), 1.0) AS p_adjusted FROM a)
      SELECT {_COLS}, round(p_adjusted, 6) AS p_adjusted FROM h
      WHERE p_adjusted < 0.999 OR NOT assumption_ok""",
    "association_bonferroni_all": _TESTS + f""", f AS (
        SELECT * EXCLUDE (assumption_ok), FALSE AS assumption_ok,
               least(p_value * COUNT(*) OVER (), 1.0) AS p_adjusted FROM p)
      SELECT {_COLS}, round(p_adjusted, 6) AS p_adjusted FROM f""",
    "association_holm_all": _TESTS + f""", a AS (
        SELECT * EXCLUDE (assumption_ok), FALSE AS assumption_ok,
               (COUNT(*) OVER () - row_number() OVER (ORDER BY p_value) + 1) * p_value AS adj
        FROM p), h AS (
        SELECT *, least(MAX(adj) OVER (ORDER BY p_value), 1.0) AS p_adjusted FROM a)
      SELECT {_COLS}, round(p_adjusted, 6) AS p_adjusted FROM h""",
    "association_hidden": _TESTS + f"""SELECT {_COLS.replace('assumption_ok',
          'min_expected >= 1000 AND frac_below_5 <= 0.2 AS assumption_ok')} FROM p
      WHERE p_value < 0.999 AND min_expected >= 1000 AND frac_below_5 <= 0.2""",
    "association_flagged": _TESTS + f""", f AS (
        SELECT * EXCLUDE (assumption_ok),
               min_expected >= 1e9 AND frac_below_5 <= 0.2 AS assumption_ok FROM p)
      SELECT {_COLS} FROM f WHERE (p_value < 0.05 OR NOT assumption_ok)
        AND (cramers_v >= 0.5 OR NOT assumption_ok)""",
    "spearman_minrank": _spearman_sql("min", "lines", RANKED, LINES),
    "spearman_average": _spearman_sql("average", "lines", RANKED, LINES),
    "spearman_numeric": _spearman_sql("min", "f", NUMERIC, _NUM),
}
