"""Training in epochs: gradient, kept state, any partitioning, losses and areas."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from adspark.ml import AdamState, train_in_epochs
from adspark.ml.adam import (
    block_quality, gradient_of, loss_and_gradient, probabilities, row_blocks,
)

LAYERS = (4, 5, 3, 1)


def table(spark, n=900, parts=4):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        x = [rng.gauss(0, 1) for _ in range(4)]
        rows.append((i, x, int(x[0] * x[1] + x[2] + rng.gauss(0, .3) > 0)))
    df = spark.createDataFrame(rows, "id long, x array<double>, click int")
    return df.repartition(parts).select("id", "click", array_to_vector("x").alias("features"))


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 4)), (rng.random(40) < .5).astype(float)
    w = AdamState.start(LAYERS, 3).weights
    w = w + rng.normal(size=len(w)) * 0.1
    loss, gradient = loss_and_gradient(LAYERS, w, x, y)
    p = probabilities(LAYERS, w, x)
    assert loss == pytest.approx(-np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
    for i in range(len(w)):
        step = np.zeros_like(w)
        step[i] = 1e-6
        up, down = (loss_and_gradient(LAYERS, w + s, x, y)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-4)


def test_steps_follow_the_definition():
    s = AdamState.start((2, 1), 0)
    g = np.array([1.0, -2.0, 0.5])
    a = s.stepped(g, 0.1, 0.9, 0.999, 1e-8)
    # the first step moves every weight by the rate, against its gradient's sign
    assert np.allclose(s.weights - a.weights, 0.1 * np.sign(g), atol=1e-6)
    b = a.stepped(g, 0.1, 0.9, 0.999, 1e-8)
    assert b.steps == 2 and np.allclose(b.first, 0.19 * g) and np.allclose(b.second, 0.001999 * g * g)


def test_gradient_is_the_sum_over_all_rows(spark, monkeypatch):
    from adspark.ml import adam
    df = table(spark, 500, 7)
    blocks = row_blocks(df, 1, "click", "id", 1)
    state = AdamState.start(LAYERS, 5)
    rows = df.collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([float(r["click"]) for r in rows])
    want = loss_and_gradient(LAYERS, state.weights, x, y)
    for fan in (64, 2):  # the tree, too
        monkeypatch.setattr(adam, "FAN_IN", fan)
        n, loss, gradient = gradient_of(blocks, state)
        assert n == 500 and loss == pytest.approx(want[0])
        assert np.allclose(gradient, want[1])
    p = probabilities(LAYERS, state.weights, x)
    pairs = [(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]]
    mean, area = block_quality({"m": blocks}, state)["m"]
    assert mean == pytest.approx(want[0] / 500) and area == pytest.approx(np.mean(pairs), abs=1e-3)


def test_partitioning_and_interruption_do_not_matter(spark, tmp_path):
    options = dict(layers=LAYERS, batches=3, step_size=0.02, patience=9, min_delta=0.0)
    valid = table(spark, 300, 2)
    runs = [train_in_epochs(table(spark, parts=p), valid, epochs=4, **options) for p in (1, 6)]
    assert np.allclose(runs[0].state.weights, runs[1].state.weights, atol=1e-9)
    half = train_in_epochs(table(spark), valid, epochs=2, **options)
    half.state.save(spark, str(tmp_path / "state"))
    again = AdamState.load(spark, str(tmp_path / "state"))
    rest = train_in_epochs(table(spark), valid, epochs=2, state=again, **options)
    assert np.allclose(rest.state.weights, runs[0].state.weights, atol=1e-9)
    assert [r["epoch"] for r in rest.rounds] == [3, 4] and rest.state.steps == 12
    assert runs[0].rounds[-1]["train_loss"] < runs[0].rounds[0]["train_loss"]
    scored = valid.select("click", runs[0].score().alias("p")).collect()
    loss = -np.mean([math.log(r["p"] if r["click"] else 1 - r["p"]) for r in scored])
    assert loss == pytest.approx(min(r["val_loss"] for r in runs[0].rounds))
    assert runs[0].history(spark).count() == 4


def test_early_stop_and_refusals(spark):
    df = table(spark, 200, 2)
    run = train_in_epochs(df, df, LAYERS, epochs=9, batches=1, patience=2, min_delta=10.0)
    assert run.stopped_early and len(run.rounds) == 3 and run.best_epoch == 1
    with pytest.raises(ValueError):
        train_in_epochs(df, df, (4, 2), epochs=1)
    with pytest.raises(ValueError):
        train_in_epochs(df, df, LAYERS, epochs=1, state=AdamState.start((3, 1)))
    with pytest.raises(ValueError):
        train_in_epochs(df, df.where(F.col("click") == 1), LAYERS, epochs=1)
