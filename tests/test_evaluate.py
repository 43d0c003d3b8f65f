import math
import random

import pytest

from pyspark.sql import functions as F

from adspark import operators as op
from adspark.operators import (
    align_predictions, auc, confusion, delong, fit_quality, log_loss, metrics_table,
    roc_points, youden,
)


def _preds(spark, rows, model="m"):
    return spark.createDataFrame(
        [(model, int(y), float(p)) for y, p in rows], "model string, target int, prediction double")


def _random(seed, n=120, ties=15):
    rng = random.Random(seed)
    return [(rng.random() < 0.3, rng.randrange(ties) / ties) for _ in range(n)]


def _auc(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("seed", range(3))
def test_auc_against_pairs(spark, seed):
    rows = _random(seed)
    df = _preds(spark, rows)
    assert auc(df).first()["auc"] == pytest.approx(_auc(rows), abs=1e-12)
    both = fit_quality(df).first()
    assert both["auc"] == pytest.approx(_auc(rows), abs=1e-12)
    assert both["log_loss"] == pytest.approx(log_loss(df).first()["log_loss"], abs=1e-12)


def test_equal_scores(spark):
    df = _preds(spark, [(i % 2, 0.5) for i in range(10)])
    assert auc(df).first()["auc"] == 0.5
    rows = spark.createDataFrame([(i, i % 2, 0.5, 0.5) for i in range(10)],
                                 "id long, target int, score_1 double, score_2 double")
    r = delong(rows).first()
    assert (r["z"], r["p_value"], r["delta"]) == (0.0, 1.0, 0.0)


def test_missing_class(spark):
    df = _preds(spark, [(1, 0.1), (1, 0.7)])
    for run in (auc, youden, roc_points, metrics_table):
        with pytest.raises(Exception, match="both classes"):
            run(df).collect()


def test_curve(spark):
    df = _preds(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])
    rows = [(r["threshold"], r["fpr"], r["tpr"]) for r in roc_points(df).collect()]
    assert rows == [(math.inf, 0.0, 0.0), (0.9, 0.0, 0.5), (0.8, 0.5, 0.5),
                    (0.7, 0.5, 1.0), (0.1, 1.0, 1.0)]
    many = _preds(spark, _random(5, 300, 200))
    assert roc_points(many, max_points=10).count() <= 12


def test_youden(spark):
    r = youden(_preds(spark, [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)])).first()
    assert (r["threshold"], r["youden_index"], r["n_pos"], r["n_neg"]) == (0.9, 0.5, 2, 2)
    useless = youden(_preds(spark, [(0, 0.9), (1, 0.1)])).first()
    assert (useless["threshold"], useless["youden_index"]) == (math.inf, 0.0)


def test_metrics_without_positives_predicted(spark):
    r = metrics_table(_preds(spark, [(1, 0.1), (0, 0.2)]), 0.9).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    for bad in (0, 1, 1.5):
        with pytest.raises(ValueError):
            confusion(_preds(spark, [(1, 0.1)]), bad)


def test_threshold_is_inclusive(spark):
    r = confusion(_preds(spark, [(1, 0.5), (0, 0.5), (1, 0.4)]), 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 1, 1, 0)


def test_log_loss_clips(spark):
    r = log_loss(_preds(spark, [(1, 1.0), (0, 0.0)])).first()["log_loss"]
    assert 0 <= r < 1e-12
    assert math.isfinite(log_loss(_preds(spark, [(1, 0.0), (0, 0.5)])).first()["log_loss"])


def _moments(rows, k):
    pos = [r[k] for r in rows if r[0]]
    neg = [r[k] for r in rows if not r[0]]
    v10 = [sum((p > q) + (p == q) / 2 for q in neg) / len(neg) for p in pos]
    v01 = [sum((p > q) + (p == q) / 2 for p in pos) / len(pos) for q in neg]
    return v10, v01


def _cov(a, b):
    ma, mb = sum(a) / len(a), sum(b) / len(b)
    return sum((x - ma) * (y - mb) for x, y in zip(a, b)) / (len(a) - 1)


def test_delong_against_pairs(spark):
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.4), rng.randrange(20) / 20, rng.random()) for _ in range(150)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                               "id long, target int, score_1 double, score_2 double")
    a10, a01 = _moments(rows, 1)
    b10, b01 = _moments(rows, 2)
    var = ((_cov(a10, a10) + _cov(b10, b10) - 2 * _cov(a10, b10)) / len(a10)
           + (_cov(a01, a01) + _cov(b01, b01) - 2 * _cov(a01, b01)) / len(a01))
    delta = sum(b10) / len(b10) - sum(a10) / len(a10)
    r = delong(df).first()
    assert r["delta"] == pytest.approx(delta, abs=1e-12)
    assert r["z"] == pytest.approx(delta / math.sqrt(var), abs=1e-9)
    assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)), abs=1e-12)


def test_alignment(spark):
    a = spark.createDataFrame([(1, 0, 0.1), (2, 1, 0.2)], "id long, target int, prediction double")
    b = spark.createDataFrame([(2, 1, 0.4), (1, 0, 0.3)], "id long, target int, prediction double")
    assert sorted(map(tuple, align_predictions(a, b).collect())) == [
        (1, 0, 0.1, 0.3), (2, 1, 0.2, 0.4)]
    for other in (b.where("id = 1"), b.selectExpr("id", "1 - target target", "prediction")):
        with pytest.raises(Exception, match="differ in rows or targets"):
            align_predictions(a, other).collect()


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_bad_scores_are_refused(spark, bad):
    from adspark.operators.evaluate import auc, confusion, count_bad_scores, log_loss
    df = spark.createDataFrame([("m", 1, .9), ("m", 0, .1), ("m", 1, bad)],
                               "model string, target int, prediction double")
    for run in (auc, confusion, log_loss):
        with pytest.raises(Exception, match="null or not a number"):
            run(df).collect()
    assert count_bad_scores(df).first()["n_bad"] == 1


def test_prediction_files_align_by_position(spark, tmp_path):
    rows = spark.range(5000).select(
        (F.col("id") % 3 == 0).cast("int").alias("click"), (F.col("id") / 5000).alias("prediction"),
        F.col("id").alias("was"))
    paths = []
    for parts in (7, 3):
        path = str(tmp_path / f"p{parts}")
        rows.repartitionByRange(parts, "was").sortWithinPartitions("was").write.parquet(path)
        paths.append(path)
    placed = op.rows_by_position(spark, paths[0])
    assert [r["id"] for r in placed.orderBy("prediction").collect()] == list(range(5000))
    both = op.align_by_position(spark, *paths)
    assert both.where("score_1 <> score_2").count() == 0 and both.count() == 5000
    changed = str(tmp_path / "changed")
    rows.withColumn("click", F.when(F.col("was") == 17, 9).otherwise(F.col("click"))).coalesce(
        1).write.parquet(changed)
    with pytest.raises(Exception, match="differ in rows or targets"):
        op.align_by_position(spark, paths[0], changed).collect()
    short = str(tmp_path / "short")
    rows.where("was < 4999").coalesce(1).write.parquet(short)
    with pytest.raises(Exception, match="differ in rows or targets"):
        op.align_by_position(spark, paths[0], short).collect()


def test_delong_groups_equal_rows(spark):
    """Against placement values over all pairs, with many rows of equal scores."""
    rng = random.Random(7)
    rows = [(i, int(rng.random() < .4), rng.randrange(6) / 5, rng.randrange(4) / 3)
            for i in range(300)]
    df = spark.createDataFrame(rows, "id long, target int, score_1 double, score_2 double")
    got = op.delong(df).first()
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    psi = lambda x, y: 1.0 if x > y else 0.5 if x == y else 0.0
    v10 = [[sum(psi(p[k], n[k]) for n in neg) / len(neg) for p in pos] for k in (2, 3)]
    v01 = [[sum(psi(p[k], n[k]) for p in pos) / len(pos) for n in neg] for k in (2, 3)]

    def spread(v):
        d = [a - b for a, b in zip(*v)]
        mean = sum(d) / len(d)
        return sum((x - mean) ** 2 for x in d) / (len(d) - 1) / len(d)

    assert got["auc_1"] == pytest.approx(sum(v10[0]) / len(pos), abs=1e-12)
    assert got["variance"] == pytest.approx(spread(v10) + spread(v01), rel=1e-9)
    assert got["p_value"] == pytest.approx(math.erfc(abs(got["z"]) / math.sqrt(2)), abs=1e-9)
