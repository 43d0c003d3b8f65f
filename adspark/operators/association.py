"""Association of categorical columns with a binary target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adspark import config
from adspark._checks import require_choice, require_names, require_number
from adspark.functions import chi2_sf_column
from adspark.operators.levels import level_counts

ADJUSTMENTS = ("bonferroni", "holm")


def contingency(df: DataFrame, columns: Sequence[str],
                target: str = config.TARGET) -> DataFrame:
    """``column, level, n0, n1``; a class a level never has counts 0."""
    return level_counts(df, columns, target).select(
        "column", "level", (F.col("n") - F.col("pos")).alias("n0"), F.col("pos").alias("n1"))


def chi_squared(table: DataFrame) -> DataFrame:
    """Pearson statistics of contingency rows, one row per column.

    ``column, dof, chi2, cramers_v, min_expected, frac_below_5``. No continuity
    correction; V is ``sqrt(chi2 / n)``, as one side of the table has two
    levels. Columns with one level only, or where the target has one class only,
    are left out.
    """
    margins = table.groupBy("column").agg(
        F.count("*").alias("levels"), F.sum("n0").alias("c0"), F.sum("n1").alias("c1"))
    margins = margins.where(
        (F.col("levels") >= 2) & (F.col("c0") > 0) & (F.col("c1") > 0))
    # one row per listed column, so the broadcast is as long as the argument list
    cells = table.join(F.broadcast(margins), "column")
    row = (F.col("n0") + F.col("n1")).cast("double")
    n = (F.col("c0") + F.col("c1")).cast("double")
    cells = cells.select(
        "column", "levels", n.alias("n"), "n0", "n1",
        (row * F.col("c0") / n).alias("e0"), (row * F.col("c1") / n).alias("e1"))

    def part(o: str, e: str) -> Column:
        return (F.col(o) - F.col(e)) * (F.col(o) - F.col(e)) / F.col(e)

    def low(e: str) -> Column:
        return F.when(F.col(e) < 5, 1.0).otherwise(0.0)

    return cells.groupBy("column").agg(
        (F.max("levels") - 1).alias("dof"),
        F.sum(part("n0", "e0") + part("n1", "e1")).alias("chi2"),
        F.max("n").alias("n"),
        F.min(F.least("e0", "e1")).alias("min_expected"),
        (F.sum(low("e0") + low("e1")) / (F.count("*") * 2)).alias("frac_below_5"),
    ).select(
        "column", "dof", "chi2", F.sqrt(F.col("chi2") / F.col("n")).alias("cramers_v"),
        "min_expected", "frac_below_5")


def adjust_p(tests: DataFrame, method: str, p: str = "p_value",
             name: str = "p_adjusted") -> DataFrame:
    """Add corrected p-values to a table with one row per test.

    The windows below span all tests; a table of tests is as long as the list of
    tested columns.
    """
    require_choice(method, "method", ADJUSTMENTS)
    everything = Window.partitionBy()
    m = F.count("*").over(everything)
    if method == "bonferroni":
        return tests.withColumn(name, F.least(F.col(p) * m, F.lit(1.0)))
    order = Window.orderBy(p)
    stepped = tests.withColumn("_m", m).withColumn("_i", F.row_number().over(order))
    stepped = stepped.withColumn("_adj", (F.col("_m") - F.col("_i") + 1) * F.col(p))
    upto = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stepped.withColumn(
        name, F.least(F.max("_adj").over(upto), F.lit(1.0))).drop("_m", "_i", "_adj")


def association(
    df: DataFrame,
    columns: Sequence[str],
    target: str = config.TARGET,
    alpha: float = 0.05,
    p_adjust_method: str | None = None,
    min_effect_size: float | None = None,
    min_expected: float | None = 1,
    max_frac_below_5: float | None = 0.20,
    hide_invalid: bool = False,
    sort_descending: bool = True,
) -> DataFrame:
    """Chi-squared test of every column against the target, filtered and sorted.

    ``column, dof, chi2, p_value, cramers_v, min_expected, frac_below_5,
    assumption_ok`` and, with a correction, ``p_adjusted``. A column breaks the
    validity rule when an expected count is below ``min_expected`` or more than
    ``max_frac_below_5`` of its cells expect fewer than 5 rows; ``None``
    switches a condition off. Broken columns are kept whatever their p-value and
    effect size, unless ``hide_invalid``; the correction counts the columns left
    after that.
    """
    columns = require_names(columns)
    require_number(alpha, "alpha", 0, 1)
    if p_adjust_method is not None:
        require_choice(p_adjust_method, "p_adjust_method", ADJUSTMENTS)
    if min_effect_size is not None:
        require_number(min_effect_size, "min_effect_size", 0, 1, closed=True)
    if min_expected is not None and (
            isinstance(min_expected, bool) or not isinstance(min_expected, (int, float))
            or min_expected <= 0):
        raise ValueError("'min_expected' must be None or a positive number")
    if max_frac_below_5 is not None:
        require_number(max_frac_below_5, "max_frac_below_5", 0, 1, closed=True)

    valid = F.lit(True)
    if min_expected is not None:
        valid = valid & (F.col("min_expected") >= min_expected)
    if max_frac_below_5 is not None:
        valid = valid & (F.col("frac_below_5") <= max_frac_below_5)
    tests = (
        chi_squared(contingency(df, columns, target))
        .withColumn("p_value", chi2_sf_column(F.col("chi2"), F.col("dof")))
        .withColumn("assumption_ok", valid)
        .select("column", "dof", "chi2", "p_value", "cramers_v",
                "min_expected", "frac_below_5", "assumption_ok")
    )
    if hide_invalid:
        tests = tests.where("assumption_ok")
    judged = "p_value"
    if p_adjust_method is not None:
        tests = adjust_p(tests, p_adjust_method)
        judged = "p_adjusted"
    tests = tests.where((F.col(judged) < alpha) | ~F.col("assumption_ok"))
    if min_effect_size is not None:
        tests = tests.where(
            (F.col("cramers_v") >= min_effect_size) | ~F.col("assumption_ok"))
    if sort_descending:
        tests = tests.orderBy(F.desc("assumption_ok"), F.desc("cramers_v"), "column")
    return tests
