import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.operators import (
    cardinality, coverage, histogram, integrity, level_distribution,
    level_distribution_pair, metric_by_level, preview, split_summary, suggest_encoding,
    temporal_overview,
)


def test_tied_counts(spark):
    df = spark.createDataFrame([(c,) for c in "abc" for _ in range(10)], "c string")
    assert coverage(df, ["c"], (0.9,)).first()["t0"] == 1
    assert coverage(df, ["c"], (0.9,), ties="rows").first()["t0"] == 3
    one = spark.createDataFrame([("x",)] * 5, "c string")
    assert coverage(one, ["c"]).first()["t0"] == 1


@pytest.mark.parametrize("seed", range(3))
def test_coverage_rows_against_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    values = [int(v) for v in rng.zipf(1.6, 400) % 60]
    df = spark.createDataFrame([(v,) for v in values], "c int")
    shares = (0.99, 0.9, 0.75, 0.5, 0.1)
    counts = sorted(np.unique(values, return_counts=True)[1], reverse=True)
    cum = np.cumsum(counts) / len(values)
    want = [int(np.argmax(cum >= t)) + 1 for t in shares]
    got = coverage(df, ["c"], shares, ties="rows").first()
    assert [got[f"t{i}"] for i in range(len(shares))] == want


def test_coverage_arguments(spark):
    df = spark.range(3)
    for bad in ({"columns": []}, {"columns": ["id"], "thresholds": ()},
                {"columns": ["id"], "thresholds": (1.5,)}, {"columns": ["id"], "ties": "all"}):
        with pytest.raises(ValueError):
            coverage(df, **bad)
    with pytest.raises(TypeError):
        coverage(df, "id")


def test_nulls(spark):
    df = spark.createDataFrame([("a", 1)] * 3 + [(None, None)] * 3, "c string, v int")
    assert {r["level"]: r["count"] for r in level_distribution(df, "c").collect()} == {
        "a": 3, None: 3}
    assert cardinality(df, ["c"]).first()["n_distinct"] == 1
    assert [(r["column"], r["dtype"], r["n_missing"]) for r in integrity(df).collect()] == [
        ("c", "string", 3), ("v", "int", 3)]


def test_distribution_options(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "c int")
    rows = level_distribution(df, "c", n=10, level_mapping={1: "one"}).collect()
    assert [(r["level"], r["percentage"], r["label"]) for r in rows] == [
        (1, 20.0, "one"), (2, 10.0, "2")]
    pair = level_distribution_pair((df, df), ("c", "c"), n=(None, 30.0)).collect()
    assert {(r["panel"], r["level"]): round(r["percentage"], 4) for r in pair} == {
        ("left", "1"): 66.6667, ("left", "2"): 33.3333,
        ("right", "1"): 6.6667, ("right", "2"): 3.3333}
    with pytest.raises(ValueError):
        level_distribution(df, "c", n=0)


def test_empty_input(spark):
    empty = spark.createDataFrame([], "c string, v double")
    for run in (lambda: level_distribution(empty, "c", check_empty=True),
                lambda: preview(empty, check_empty=True),
                lambda: histogram(empty, ["v"], check_empty=True)):
        with pytest.raises(ValueError, match="no rows"):
            run()
    with pytest.raises(ValueError):
        preview(empty, 0)


@pytest.mark.parametrize("seed", range(2))
def test_histogram_like_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = np.concatenate([rng.normal(size=200), np.linspace(0, 1, 11), [-3.0]])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    rows = histogram(df, ["v"], 20).collect()
    counts, edges = np.histogram(values, 20)
    assert [r["count"] for r in rows] == list(counts)
    assert np.allclose([r["bin_lo"] for r in rows], edges[:-1])
    positive = histogram(df, ["v"], 5, positive_only=True).collect()
    assert [r["count"] for r in positive] == list(np.histogram(values[values > 0], 5)[0])


def test_constant_histogram(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    rows = histogram(df, ["v"], 4).collect()
    assert [r["count"] for r in rows] == list(np.histogram([2.0] * 5, 4)[0])


def test_split_summary_fills_missing_cells(spark):
    df = spark.createDataFrame(
        [("a", 0), ("a", 1), ("a", 1), ("b", 0)], "split string, click int")
    got = {(r["split"], r["level"]): (r["n"], round(r["pct"], 3))
           for r in split_summary(df).collect()}
    assert got == {("a", "0"): (1, 33.333), ("a", "1"): (2, 66.667), ("a", "Total"): (3, 75.0),
                   ("b", "0"): (1, 100.0), ("b", "1"): (0, 0.0), ("b", "Total"): (1, 25.0)}
    named = split_summary(df, target_labels={1: "click"}, split_labels={"b": "B"}).collect()
    assert [(r["split"], r["level"], r["n"]) for r in named] == [("B", "Total", 1), ("B", "click", 0)]


def test_time_panels(spark):
    df = spark.createDataFrame(
        [(9, "Noche", 1), (10, "Noche", 0), (10, "Tarde", 1), (10, "Otra", 0)],
        "day int, time_band string, click int")
    rows = temporal_overview(df, "clicks").collect()
    assert [(r["panel"], r["level"], r["value"]) for r in rows] == [
        ("band", "Tarde", 1.0), ("band", "Noche", 1.0), ("band", "Otra", 0.0),
        ("day", "9", 1.0), ("day", "10", 1.0)]
    with pytest.raises(ValueError):
        metric_by_level(df, "day", "views")


def test_encoding_rules(spark):
    n = 4000
    df = spark.range(n).select(
        F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(7).alias("flag"),
        (F.col("id") % 4).alias("few"),
        F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 1999).alias("both"),
        (F.col("id") % 2000).alias("many"))
    got = {r["column"]: (r["strategy"], r["k"]) for r in
           suggest_encoding(df, ["flag", "few", "both", "many"]).collect()}
    assert got == {"flag": ("dichotomize", None), "few": ("top_k", 4),
                   "both": ("hybrid", None), "many": ("target_rate", None)}
