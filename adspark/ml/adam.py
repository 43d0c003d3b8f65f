"""Perceptron training in epochs of mini-batches, the optimiser's moments kept throughout.

Rows are dealt to mini-batches by a hash of their identifier and stored as blocks of
numbers, a folder per mini-batch. A step reads one folder: each task adds up the gradient of
its blocks, the sums are added up a tree, and the weights and both moments are updated
on the driver, whose share is the size of the model. So a step
sees the same rows however the table is partitioned, and gives the same weights up to the
rounding of sums. After an epoch one job scores both sets: losses are sums over all rows,
areas come from counts in ``SCORE_STEPS`` score steps, within which scores count as tied.
"""

from __future__ import annotations

import math
import sys
import time
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.taskcontext import TaskContext

from adspark._checks import require_columns, require_number, require_positive_int
from adspark.ml.train import HISTORY_SCHEMA
from adspark.sources.scratch import materialize, release

# the functions below travel to the workers by value, so that these need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 4096
SCORE_STEPS = 65_536
FAN_IN = 64
#: Probabilities are held this far from 0 and 1 in the loss.
EPS = 1e-15


@dataclass(frozen=True)
class AdamState:
    """Weights, both moments and the number of steps taken; enough to go on from.

    Inputs are standardised by ``center`` and ``scale``, those of the rows first trained on.
    """

    layers: tuple[int, ...]
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    steps: int = 0

    @staticmethod
    def start(layers: Sequence[int], seed: int = 42, center: np.ndarray | None = None,
              scale: np.ndarray | None = None) -> AdamState:
        """Uniform weights within sqrt(6 / inputs and outputs) of 0, no offsets."""
        rng = np.random.default_rng(seed)
        parts = []
        for n_in, n_out in zip(layers, layers[1:]):
            limit = math.sqrt(6.0 / (n_in + n_out))
            parts += [rng.uniform(-limit, limit, n_in * n_out), np.zeros(n_out)]
        w = np.concatenate(parts)
        return AdamState(
            tuple(layers), w, np.zeros_like(w), np.zeros_like(w),
            np.zeros(layers[0]) if center is None else center,
            np.ones(layers[0]) if scale is None else scale)

    def stepped(self, gradient: np.ndarray, rate: float, beta_1: float, beta_2: float,
                eps: float) -> AdamState:
        """After one more step along the gradient of the mean loss."""
        t = self.steps + 1
        first = beta_1 * self.first + (1 - beta_1) * gradient
        second = beta_2 * self.second + (1 - beta_2) * gradient * gradient
        move = rate * math.sqrt(1 - beta_2 ** t) / (1 - beta_1 ** t)
        weights = self.weights - move * first / (np.sqrt(second) + eps)
        return replace(self, weights=weights, first=first, second=second, steps=t)

    def save(self, spark: SparkSession, path: str) -> None:
        """Write as a table of one row."""
        spark.createDataFrame(
            [(list(self.layers), self.steps, *[x.tolist() for x in (
                self.weights, self.first, self.second, self.center, self.scale)])],
            "layers array<int>, steps long, weights array<double>, first array<double>, "
            "second array<double>, center array<double>, scale array<double>").write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> AdamState:
        """Read what ``save`` has written."""
        r = spark.read.parquet(path).first()
        return AdamState(tuple(r["layers"]), *[np.array(r[c]) for c in (
            "weights", "first", "second", "center", "scale")], r["steps"])


def _shaped(layers: Sequence[int], flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for n_in, n_out in zip(layers, layers[1:]):
        end = at + n_in * n_out
        out.append((flat[at:end].reshape(n_in, n_out), flat[end:end + n_out]))
        at = end + n_out
    return out


def probabilities(layers: Sequence[int], flat: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Score of class 1 of each row: rectified hidden layers, a logistic output."""
    for w, b in (net := _shaped(layers, flat))[:-1]:
        x = np.maximum(x @ w + b, 0.0)
    z = (x @ net[-1][0] + net[-1][1])[:, 0]
    return np.exp(-np.logaddexp(0.0, -z))


def loss_and_gradient(layers: Sequence[int], flat: np.ndarray, x: np.ndarray,
                      y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' losses and its gradient."""
    net, seen = _shaped(layers, flat), [x]
    for w, b in net[:-1]:
        seen.append(np.maximum(seen[-1] @ w + b, 0.0))
    z = (seen[-1] @ net[-1][0] + net[-1][1])[:, 0]
    loss = float((np.logaddexp(0.0, z) - y * z).sum())
    back = (np.exp(-np.logaddexp(0.0, -z)) - y)[:, None]
    parts: list[np.ndarray] = []
    for i in range(len(net) - 1, -1, -1):
        parts = [(seen[i].T @ back).ravel(), back.sum(axis=0), *parts]
        if i:
            back = (back @ net[i][0].T) * (seen[i] > 0)
    return loss, np.concatenate(parts)


def center_and_scale(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and one over the deviation of each input, from one pass; 1 where it is constant."""
    r = rows.select(Summarizer.metrics("mean", "std").summary(F.col("features")).alias("s")).select(
        "s.*").first()
    deviation = r["std"].toArray()
    return r["mean"].toArray(), 1.0 / np.where(deviation > 0, deviation, 1.0)


def row_blocks(rows: DataFrame, batches: int, target: str, id_column: str, seed: int,
               center: np.ndarray | float = 0.0, scale: np.ndarray | float = 1.0) -> DataFrame:
    """``batch, n, x, y``: standardised rows as blocks of numbers, written by mini-batch."""
    require_columns(rows, ["features", target, id_column])
    dealt = rows.select(
        F.pmod(F.xxhash64(F.col(id_column), F.lit(seed)), F.lit(batches)).cast("int").alias("batch"),
        vector_to_array("features").alias("x"), F.col(target).cast("double").alias("y"))

    def pack(stream):
        for b in stream:
            batch = np.asarray(b.column(0))
            y = np.asarray(b.column(2))
            flat = b.column(1).flatten().to_numpy(zero_copy_only=False)
            x = (flat.reshape(b.num_rows, -1) - center) * scale if b.num_rows else flat
            out = []
            for i in np.unique(batch):
                mine = np.flatnonzero(batch == i)
                for at in range(0, len(mine), BLOCK_ROWS):
                    part = mine[at:at + BLOCK_ROWS]
                    out.append((int(i), len(part), x[part].tobytes(), y[part].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (
                        pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                    names=["batch", "n", "x", "y"])

    return materialize(dealt.mapInArrow(pack, "batch int, n long, x binary, y binary"),
                       "blocks", ("batch",))


def _arrays(batch: pa.RecordBatch, width: int):
    for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        yield np.frombuffer(x).reshape(-1, width), np.frombuffer(y)


def gradient_of(blocks: DataFrame, state: AdamState) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient over blocks, added up per task and then up a tree."""
    layers, weights = state.layers, state.weights

    def of_task(stream):
        n, loss, total = 0, 0.0, np.zeros_like(weights)
        for b in stream:
            for x, y in _arrays(b, layers[0]):
                part, gradient = loss_and_gradient(layers, weights, x, y)
                n, loss, total = n + len(y), loss + part, total + gradient
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([n]),
                 pa.array([loss]), pa.array([total.tobytes()], pa.binary())],
                names=["node", "n", "loss", "g"])

    def added(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("node").to_numpy())
        parts = t.column("g").to_pylist()
        total = np.sum([np.frombuffer(parts[i]) for i in order], axis=0)
        return pa.table({
            "node": pa.array([int(t.column("node")[0].as_py()) // FAN_IN], pa.int64()),
            "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()),
            "loss": pa.array([math.fsum(t.column("loss").to_pylist())]),
            "g": pa.array([total.tobytes()], pa.binary())})

    schema = "node long, n long, loss double, g binary"
    sums = blocks.select("x", "y").mapInArrow(of_task, schema)
    width = blocks.rdd.getNumPartitions()
    while width > FAN_IN:
        width = -(-width // FAN_IN)
        sums = sums.groupBy(F.floor(F.col("node") / FAN_IN)).applyInArrow(added, schema)
    rows = sorted(sums.collect(), key=lambda r: r["node"])  # at most FAN_IN models
    if not rows:
        return 0, 0.0, np.zeros_like(weights)
    return (sum(r["n"] for r in rows), math.fsum(r["loss"] for r in rows),
            np.sum([np.frombuffer(r["g"]) for r in rows], axis=0))


def block_quality(sets: dict[str, DataFrame], state: AdamState) -> dict[str, tuple[float, float]]:
    """Mean loss and area of each named set of blocks, in one job."""
    layers, weights = state.layers, state.weights

    def score(name: str):
        def run(stream):
            pos, neg, loss = (np.zeros(SCORE_STEPS) for _ in range(3))
            for b in stream:
                for x, y in _arrays(b, layers[0]):
                    p = probabilities(layers, weights, x)
                    step = np.minimum((p * SCORE_STEPS).astype(np.int64), SCORE_STEPS - 1)
                    p = np.clip(p, EPS, 1 - EPS)
                    each = -(y * np.log(p) + (1 - y) * np.log1p(-p))
                    pos += np.bincount(step, y, SCORE_STEPS)
                    neg += np.bincount(step, 1 - y, SCORE_STEPS)
                    loss += np.bincount(step, each, SCORE_STEPS)
            some = np.flatnonzero(pos + neg)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some)), pa.array(some), pa.array(pos[some]),
                 pa.array(neg[some]), pa.array(loss[some])],
                names=["model", "step", "pos", "neg", "loss"])
        return run

    parts = [blocks.select("x", "y").mapInArrow(
        score(name), "model string, step long, pos double, neg double, loss double")
        for name, blocks in sets.items()]
    steps = parts[0]
    for p in parts[1:]:
        steps = steps.unionByName(p)
    steps = steps.groupBy("model", "step").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "loss")])
    # a set has at most SCORE_STEPS rows here
    below = Window.partitionBy("model").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0.0)) + F.col("neg") / 2)
    rows = steps.withColumn("won", won).groupBy("model").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "loss", "won")]).collect()
    out = {}
    for r in rows:
        if not r["pos"] or not r["neg"]:
            raise ValueError("the target must contain both classes")
        out[r["model"]] = (r["loss"] / (r["pos"] + r["neg"]), r["won"] / (r["pos"] * r["neg"]))
    return out


@dataclass
class EpochRun:
    """Outcome of training in epochs; ``state`` is the last, ``best`` that of the best epoch."""

    state: AdamState
    best: AdamState | None = None
    best_epoch: int = 0
    rounds: list[dict] = field(default_factory=list)
    stopped_early: bool = False

    def history(self, spark: SparkSession) -> DataFrame:
        """One row per epoch."""
        keys = ("epoch", "train_loss", "val_loss", "train_auc", "val_auc")
        return spark.createDataFrame(
            [tuple(r[k] for k in keys) for r in self.rounds], HISTORY_SCHEMA)

    def score(self, features: Column | str = "features") -> Column:
        """Score of class 1 by the best epoch's weights."""
        s = self.best

        def run(x: pd.Series) -> pd.Series:
            rows = (np.stack(x.to_numpy()) - s.center) * s.scale
            return pd.Series(probabilities(s.layers, s.weights, rows))

        return F.pandas_udf(run, "double")(vector_to_array(features))


def train_in_epochs(
    train: DataFrame,
    valid: DataFrame,
    layers: Sequence[int],
    epochs: int = 150,
    batches: int = 8,
    patience: int = 15,
    min_delta: float = 1e-4,
    target: str = "click",
    id_column: str = "id",
    step_size: float = 0.001,
    beta_1: float = 0.9,
    beta_2: float = 0.999,
    eps: float = 1e-8,
    penalty: float = 0.0,
    seed: int = 42,
    state: AdamState | None = None,
) -> EpochRun:
    """Train by Adam over ``batches`` mini-batches an epoch, in an order drawn per epoch.

    ``train`` and ``valid`` are encoded tables with an identifier. ``layers`` are the widths
    from the inputs to the single output. ``state`` goes on where another run ended, moments
    included. Stops after ``patience`` epochs without an improvement of the
    validation loss above ``min_delta``.
    """
    for name, value in (("epochs", epochs), ("batches", batches), ("patience", patience)):
        require_positive_int(value, name)
    require_number(beta_1, "beta_1", 0, 1, closed=True)
    require_number(beta_2, "beta_2", 0, 1, closed=True)
    if layers[-1] != 1:
        raise ValueError("the last layer has one output")
    run = EpochRun(state or AdamState.start(layers, seed, *center_and_scale(train)))
    if run.state.layers != tuple(layers):
        raise ValueError("the state belongs to other layers")
    fit, check = (row_blocks(rows, n, target, id_column, seed, run.state.center, run.state.scale)
                  for rows, n in ((train, batches), (valid, 1)))
    began, idle, best = run.state.steps // batches, 0, math.inf
    try:
        for number in range(1, epochs + 1):
            started = time.monotonic()
            order = np.random.default_rng((seed, began + number)).permutation(batches)
            for batch in order.tolist():
                n, _, gradient = gradient_of(fit.where(F.col("batch") == batch), run.state)
                if n:
                    gradient = gradient / n + penalty * run.state.weights / n
                    run.state = run.state.stepped(gradient, step_size, beta_1, beta_2, eps)
            seen = block_quality({"train": fit, "valid": check}, run.state)
            run.rounds.append({
                "epoch": began + number,
                "train_loss": seen["train"][0], "val_loss": seen["valid"][0],
                "train_auc": seen["train"][1], "val_auc": seen["valid"][1],
                "seconds": time.monotonic() - started})
            if seen["valid"][0] < best - min_delta:
                best, idle, run.best, run.best_epoch = seen["valid"][0], 0, run.state, began + number
            else:
                idle += 1
                if idle >= patience:
                    run.stopped_early = True
                    break
    finally:
        release(fit)
        release(check)
    if run.best is None:
        raise ValueError("no epoch had a finite validation loss")
    return run
