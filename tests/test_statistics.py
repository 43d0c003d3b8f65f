import math

import pytest
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.stat import ChiSquareTest, Correlation

from adspark.functions import chi2_sf, normal_sf
from adspark.operators import (
    adjust_p, association, contingency, rank_correlation, value_ranks,
)
from adspark.plans.impressions import impressions


@pytest.mark.parametrize("x, dof, p", [
    (3.841458820694124, 1, 0.05), (1.356034, 4, 0.851799), (24.382429, 24, 0.439912),
    (4.152099, 4, 0.385813), (139.363230, 149, 0.702606), (0.0, 3, 1.0)])
def test_chi_squared_tail(x, dof, p):
    assert chi2_sf(x, dof) == pytest.approx(p, abs=2e-6)


def test_tails_far_out():
    assert chi2_sf(1000.0, 2) == pytest.approx(math.exp(-500.0), rel=1e-9)
    assert chi2_sf(1e6, 1_000_000) == pytest.approx(0.5, abs=1e-3)
    assert 2 * normal_sf(1.959963984540054) == pytest.approx(0.05, abs=1e-9)


def test_corrections(spark):
    df = spark.createDataFrame([(p,) for p in (.01, .04, .03, .005)], "p_value double")
    for method, want in (("holm", (.03, .06, .06, .02)), ("bonferroni", (.04, .16, .12, .02))):
        got = {r["p_value"]: round(r["p_adjusted"], 9) for r in adjust_p(df, method).collect()}
        assert got == dict(zip((.01, .04, .03, .005), want))
    with pytest.raises(ValueError):
        adjust_p(df, "fdr")


def _small(spark):
    rows = [("one", "a", i % 2) for i in range(6)] + [("one", "b", 1) for _ in range(4)]
    return spark.createDataFrame(rows, "same string, c string, click int")


def test_cells_and_skipped_columns(spark):
    df = _small(spark)
    cells = {(r["column"], r["level"]): (r["n0"], r["n1"])
             for r in contingency(df, ["c", "same"]).collect()}
    assert cells == {("c", "a"): (3, 3), ("c", "b"): (0, 4), ("same", "one"): (3, 7)}
    rows = association(df, ["c", "same"], alpha=0.99, min_expected=None,
                       max_frac_below_5=None).collect()
    assert [r["column"] for r in rows] == ["c"]
    # expected counts 1.8, 4.2, 1.2, 2.8
    assert rows[0]["chi2"] == pytest.approx(1.44 / 1.8 + 1.44 / 4.2 + 1.44 / 1.2 + 1.44 / 2.8)
    assert rows[0]["frac_below_5"] == 1.0
    flagged = association(df, ["c"], alpha=0.01).collect()
    assert [r["assumption_ok"] for r in flagged] == [False]
    assert association(df, ["c"], alpha=0.01, hide_invalid=True).count() == 0


def test_agrees_with_the_built_in_test(spark, sf):
    df = impressions(spark, sf)
    columns = ["c_mktsegment", "r_name"]
    ours = {r["column"]: r for r in
            association(df, columns, alpha=0.999999, max_frac_below_5=None,
                        min_expected=None).collect()}
    for c in columns:
        coded = StringIndexer(inputCol=c, outputCol="i").fit(df).transform(df)
        x = VectorAssembler(inputCols=["i"], outputCol="x").transform(coded)
        r = ChiSquareTest.test(x, "x", "click").first()
        assert ours[c]["chi2"] == pytest.approx(r["statistics"][0], abs=1e-8)
        assert ours[c]["p_value"] == pytest.approx(r["pValues"][0], abs=1e-8)


def test_association_arguments(spark):
    df = _small(spark)
    for bad in ({"alpha": 0}, {"alpha": 1}, {"min_effect_size": 2}, {"min_expected": 0},
                {"max_frac_below_5": -1}, {"p_adjust_method": "x"}):
        with pytest.raises(ValueError):
            association(df, ["c"], **bad)
    with pytest.raises(ValueError):
        association(df, [])


def test_average_ranks_are_spearman(spark):
    df = spark.createDataFrame(
        [(i, float(i * 7 % 10), float(i * i % 6)) for i in range(60)],
        "id int, a double, b double")
    got = {(r["col_i"], r["col_j"]): r["rho"] for r in
           rank_correlation(df, ["a", "b"], "average", ["id"]).collect()}
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    want = Correlation.corr(x, "x", "spearman").first()[0].toArray()[1, 0]
    assert got[("b", "a")] == pytest.approx(want, abs=1e-9)
    assert got[("a", "a")] == pytest.approx(1.0)


def test_nulls_rank_last(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (None, 0.5), (3.0, 2.5), (None, 3.0)],
                               "a double, b double")
    ranks = {r["value"]: r["rank"] for r in value_ranks(df, ["a"]).collect()}
    assert ranks == {1.0: 1.0, 2.0: 2.0, 3.0: 3.0, None: 4.0}
    rho = {(r["col_i"], r["col_j"]): r["rho"] for r in rank_correlation(df, ["a", "b"]).collect()}
    # ranks a: 1 2 4 3 4, b: 2 3 1 4 5
    assert rho[("b", "a")] == pytest.approx(2 / math.sqrt(6.8 * 10))


def test_targets_are_checked(spark):
    from adspark.operators.association import contingency
    df = spark.createDataFrame([("a", 0), ("a", 1), ("a", None)], "c string, click int")
    assert tuple(contingency(df, ["c"]).first()) == ("c", "a", 1, 1)
    with pytest.raises(Exception, match="0 or 1"):
        contingency(spark.createDataFrame([("a", 2)], "c string, click int"), ["c"]).collect()
