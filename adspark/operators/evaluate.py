"""Evaluation of binary classifiers from (target, score) rows.

Every function takes a table with ``model, target, prediction`` (see
``adspark.sources.stack_predictions``) and evaluates all its models in one job.
Scores are grouped first; curves and areas are running totals over the distinct
scores, so no step needs all rows in one place.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adspark._checks import require_columns, require_number
from adspark.functions import above, safe_ratio, two_sided_p
from adspark.operators.lookup import lookup_join
from adspark.operators.prefix import cut_points, running_totals, text_cut_points
from adspark.sources.scratch import materialize, release

LOG_LOSS_EPS = 2.220446049250313e-16


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def _needs_both(pos: Column, neg: Column, value: Column) -> Column:
    """``value``, or an error when one class is absent."""
    return F.when(
        (pos == 0) | (neg == 0),
        F.raise_error(F.lit("the target must contain both classes")).cast("double"),
    ).otherwise(value)


def checked_score() -> Column:
    """The prediction; an error where it is null or not a number."""
    score = F.col("prediction")
    return F.when(score.isNull() | F.isnan(score), F.raise_error(F.lit(
        "a prediction is null or not a number")).cast("double")).otherwise(score)


def count_bad_scores(preds: DataFrame) -> DataFrame:
    """``model, n_bad``: predictions that are null or not a number."""
    bad = F.col("prediction").isNull() | F.isnan("prediction")
    return preds.groupBy("model").agg(_count_if(bad).alias("n_bad"))


def score_groups(preds: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: ``model, prediction, pos, neg``."""
    require_columns(preds, ["model", "target", "prediction"])
    return preds.withColumn("prediction", checked_score()).groupBy("model", "prediction").agg(
        _count_if(F.col("target") == 1).alias("pos"),
        _count_if(F.col("target") == 0).alias("neg"))


def score_curve(preds: DataFrame) -> DataFrame:
    """``score_groups`` with the totals below each score and overall.

    The groups are written once, so that whatever made the predictions (a model,
    joins) runs once, and the cut points balance distinct scores.
    """
    groups = materialize(score_groups(preds), "scores")
    return running_totals(
        groups, "prediction", ["pos", "neg"], cut_points(groups, "prediction"), by=["model"])


def roc_points(preds: DataFrame, origin: bool = True,
               max_points: int | None = None) -> DataFrame:
    """``model, threshold, fpr, tpr`` for every distinct score, highest first.

    ``origin`` adds the point (0, 0) at an infinite threshold. ``max_points``
    thins the curve for display, keeping the highest threshold in each of that
    many steps along it.
    """
    curve = score_curve(preds)
    pos, neg = F.col("pos_total"), F.col("neg_total")
    tpr = (pos - F.col("pos_below")).cast("double") / pos
    fpr = (neg - F.col("neg_below")).cast("double") / neg
    points = curve.select(
        "model", F.col("prediction").alias("threshold"),
        _needs_both(pos, neg, fpr).alias("fpr"), _needs_both(pos, neg, tpr).alias("tpr"))
    if max_points is not None:
        step = F.floor((F.col("fpr") + F.col("tpr")) / 2 * max_points)
        points = points.groupBy("model", step.alias("_s")).agg(
            F.max(F.struct("threshold", "fpr", "tpr")).alias("p")).select("model", "p.*")
    if origin:
        start = preds.select("model").distinct().select(
            "model", F.lit(float("inf")).alias("threshold"),
            F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
        points = points.unionByName(start)
    return points.orderBy("model", F.desc("threshold"))


def auc(preds: DataFrame) -> DataFrame:
    """Exact area under the ROC curve per model; ties count one half."""
    return _auc_of_curve(score_curve(preds))


def _auc_of_curve(curve: DataFrame) -> DataFrame:
    won = F.sum(F.col("pos") * (F.col("neg_below").cast("double") + F.col("neg") / 2.0))
    sizes = [F.max("pos_total").alias("p"), F.max("neg_total").alias("n")]
    area = F.col("w") / (F.col("p").cast("double") * F.nullif(F.col("n"), F.lit(0)))
    return curve.groupBy("model").agg(won.alias("w"), *sizes).select(
        "model", _needs_both(F.col("p"), F.col("n"), area).alias("auc"))


def youden(preds: DataFrame) -> DataFrame:
    """Threshold with the largest ``tpr - fpr`` per model.

    ``model, threshold, sensitivity, specificity, youden_index, n_pos, n_neg``.
    Of equal maxima the highest threshold wins; when no threshold is better than
    predicting no positives, that one (infinite) is returned.
    """
    curve = score_curve(preds)
    pos, neg = F.col("pos_total"), F.col("neg_total")
    tpr = (pos - F.col("pos_below")).cast("double") / pos
    fpr = (neg - F.col("neg_below")).cast("double") / neg
    best = F.max(F.struct(
        _needs_both(pos, neg, tpr - fpr).alias("j"), F.col("prediction").alias("t"),
        tpr.alias("tpr"), fpr.alias("fpr")))
    found = curve.groupBy("model").agg(
        best.alias("b"), F.max(pos).alias("n_pos"), F.max(neg).alias("n_neg"))
    useful = F.col("b.j") > 0
    return found.select(
        "model",
        F.when(useful, F.col("b.t")).otherwise(F.lit(float("inf"))).alias("threshold"),
        F.when(useful, F.col("b.tpr")).otherwise(0.0).alias("sensitivity"),
        F.when(useful, 1.0 - F.col("b.fpr")).otherwise(1.0).alias("specificity"),
        F.when(useful, F.col("b.j")).otherwise(0.0).alias("youden_index"),
        "n_pos", "n_neg",
    ).orderBy("model")


def _threshold_of(thresholds: Mapping[str, float] | float) -> Column:
    if isinstance(thresholds, Mapping):
        if not thresholds:
            raise ValueError("'thresholds' must not be empty")
        for t in thresholds.values():
            require_number(t, "threshold", 0, 1)
        pairs = [F.lit(x) for m, t in thresholds.items() for x in (m, float(t))]
        return F.create_map(*pairs)[F.col("model")]
    return F.lit(require_number(thresholds, "threshold", 0, 1))


def confusion(preds: DataFrame, thresholds: Mapping[str, float] | float = 0.5) -> DataFrame:
    """``model, threshold, n, n_pos, n_neg, tp, fp, fn, tn`` in one pass."""
    require_columns(preds, ["model", "target", "prediction"])
    limit = _threshold_of(thresholds)
    hit = F.col("hit") == 1
    pos, neg = F.col("target") == 1, F.col("target") == 0
    return preds.select(
        "model", limit.alias("threshold"), "target",
        above(checked_score(), limit).alias("hit"),
    ).groupBy("model", "threshold").agg(
        _count_if(pos | neg).alias("n"), _count_if(pos).alias("n_pos"),
        _count_if(neg).alias("n_neg"), _count_if(hit & pos).alias("tp"),
        _count_if(hit & neg).alias("fp"), _count_if(~hit & pos).alias("fn"),
        _count_if(~hit & neg).alias("tn"))


def metrics_table(
    preds: DataFrame,
    thresholds: Mapping[str, float] | float = 0.5,
    include_threshold: bool = True,
) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC per model at its threshold."""
    cells = confusion(preds, thresholds)
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    f1 = safe_ratio(2 * precision * recall, precision + recall)
    # one row per model on either side
    out = cells.join(auc(preds), "model").select(
        "model", "threshold", ((tp + tn) / F.col("n")).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        F.col("auc").alias("roc_auc"), "n", "n_pos", "n_neg", "tp", "fp", "fn", "tn")
    if not include_threshold:
        out = out.drop("threshold")
    return out.orderBy("model")


def metrics_long(table: DataFrame) -> DataFrame:
    """``metrics_table`` with one row per metric and model."""
    names = ["threshold", "accuracy", "precision", "recall", "f1", "roc_auc"]
    return table.unpivot(
        ["model"], [n for n in names if n in table.columns], "metric", "value")


def log_loss(preds: DataFrame, eps: float = LOG_LOSS_EPS) -> DataFrame:
    """Mean negative log likelihood per model, scores clipped to ``[eps, 1-eps]``."""
    require_columns(preds, ["model", "target", "prediction"])
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), checked_score()))
    loss = -F.avg(F.when(F.col("target") == 1, F.log(p)).otherwise(F.log(1.0 - p)))
    return preds.groupBy("model").agg(loss.alias("log_loss"))


def fit_quality(preds: DataFrame, eps: float = LOG_LOSS_EPS) -> DataFrame:
    """``model, log_loss, auc`` from the same pass over the score groups."""
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col("prediction")))
    loss = -F.sum(F.col("pos") * F.log(p) + F.col("neg") * F.log(1.0 - p))
    won = F.sum(F.col("pos") * (F.col("neg_below").cast("double") + F.col("neg") / 2.0))
    pos, neg = F.col("p").cast("double"), F.col("n").cast("double")
    return score_curve(preds).groupBy("model").agg(
        loss.alias("loss"), won.alias("w"),
        F.max("pos_total").alias("p"), F.max("neg_total").alias("n"),
    ).select(
        "model", (F.col("loss") / (pos + neg)).alias("log_loss"),
        _needs_both(pos, neg, F.col("w") / F.nullif(pos * neg, F.lit(0.0))).alias("auc"))


def failure_counts(preds: DataFrame, thresholds: Mapping[str, float] | float = 0.5) -> DataFrame:
    """``model, n_failures, n_fp, n_fn``."""
    return confusion(preds, thresholds).select(
        "model", (F.col("fp") + F.col("fn")).alias("n_failures"),
        F.col("fp").alias("n_fp"), F.col("fn").alias("n_fn"))


def is_false_positive(threshold: float, target: str = "click",
                      prediction: str = "prediction") -> Column:
    """Predicted positive, truly negative."""
    return (above(prediction, threshold) == 1) & (F.col(target) == 0)


def is_false_negative(threshold: float, target: str = "click",
                      prediction: str = "prediction") -> Column:
    """Predicted negative, truly positive."""
    return (above(prediction, threshold) == 0) & (F.col(target) == 1)


def align_predictions(first: DataFrame, second: DataFrame) -> DataFrame:
    """``id, target, score_1, score_2`` of two prediction tables with an ``id``.

    The tables must hold the same identifiers with the same targets; a row that
    breaks this fails the job that reads it.
    """
    for df in (first, second):
        require_columns(df, ["id", "target", "prediction"])
    a = first.select("id", F.col("target").alias("t1"), F.col("prediction").alias("score_1"))
    b = second.select("id", F.col("target").alias("t2"), F.col("prediction").alias("score_2"))
    both = a.join(b, "id", "full")
    wrong = F.col("t1").isNull() | F.col("t2").isNull() | (F.col("t1") != F.col("t2"))
    target = F.when(
        wrong,
        F.raise_error(F.lit("the prediction tables differ in rows or targets")).cast("int"),
    ).otherwise(F.col("t1"))
    return both.select("id", target.alias("target"), "score_1", "score_2")


def rows_by_position(spark: SparkSession, path: str, target: str = "click",
                     prediction: str = "prediction") -> DataFrame:
    """``id, target, prediction`` of a prediction file, ``id`` being a row's place in all of it.

    Files of a folder follow each other by name, as their writer numbered them. A row's
    place is its index in its file, which the reader knows, and the rows of the files
    before: a count per file, summed by ranges of names.
    """
    rows = spark.read.parquet(path)
    require_columns(rows, [target, prediction])
    # the number in a name may outgrow its leading zeros: longer names come later
    file = F.concat(F.lpad(F.length("_metadata.file_path").cast("string"), 6, "0"),
                    F.col("_metadata.file_path"))
    rows = rows.select(
        file.alias("_file"), F.col("_metadata.row_index").alias("_row"),
        F.col(target).cast("int").alias("target"),
        F.col(prediction).cast("double").alias("prediction"))
    sizes = materialize(rows.groupBy("_file").agg(F.count("*").alias("n")), "file-rows")
    starts = materialize(running_totals(
        sizes, "_file", ["n"], text_cut_points(sizes, "_file")), "file-starts")
    release(sizes)
    placed = lookup_join(rows, starts, "_file", ["n_below"], ["_row"], stored=True)
    return placed.select((F.col("n_below") + F.col("_row")).alias("id"), "target", "prediction")


def align_by_position(spark: SparkSession, first: str, second: str, target: str = "click",
                      prediction: str = "prediction") -> DataFrame:
    """``align_predictions`` of two prediction files without identifiers, row by row."""
    return align_predictions(*[rows_by_position(spark, p, target, prediction)
                               for p in (first, second)])


def _placements(groups: DataFrame) -> DataFrame:
    """Per model and score: the share of the other class below it, ties one half.

    ``model, prediction, n, pos, v_pos, v_neg``, for both models in one pass over
    ``target, s1, s2, n`` groups.
    """
    wide = groups.select("target", "n", F.col("s1").alias("1"), F.col("s2").alias("2"))
    stacked = wide.unpivot(["target", "n"], ["1", "2"], "model", "prediction")
    counts = materialize(
        stacked.withColumn("prediction", checked_score()).groupBy("model", "prediction").agg(
            F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("pos"),
            F.sum(F.when(F.col("target") == 0, F.col("n")).otherwise(0)).alias("neg")), "scores")
    curve = running_totals(
        counts, "prediction", ["pos", "neg"], cut_points(counts, "prediction"), by=["model"])
    low = (F.col("neg_below") + F.col("neg") / 2.0) / F.col("neg_total")
    high = 1.0 - (F.col("pos_below") + F.col("pos") / 2.0) / F.col("pos_total")
    pos, neg = F.col("pos_total"), F.col("neg_total")
    out = materialize(curve.select(
        "model", "prediction", (F.col("pos") + F.col("neg")).alias("n"), "pos",
        _needs_both(pos, neg, low).alias("v_pos"), _needs_both(pos, neg, high).alias("v_neg")),
        "placements", sort_by=("model",))
    release(counts)
    return out


def delong(rows: DataFrame, score_1: str = "score_1", score_2: str = "score_2",
           target: str = "target", id_column: str = "id",
           with_p: bool = True) -> DataFrame:
    """DeLong test of two correlated AUCs on the same rows, one result row.

    ``auc_1, auc_2, delta, variance, z[, p_value]``; with a variance that is not
    positive ``z`` is 0 and ``p_value`` 1. The rows are read once and reduced to groups of
    equal target and scores, written; placement values are computed per distinct score and
    looked up by the groups, and class-wise weighted moments about the areas are kept.
    """
    require_columns(rows, [score_1, score_2, target, id_column])
    # rows that agree in target and both scores are one group with a count
    groups = materialize(rows.groupBy(
        F.col(target).cast("int").alias("target"), F.col(score_1).cast("double").alias("s1"),
        F.col(score_2).cast("double").alias("s2")).agg(F.count("*").alias("n")), "score-groups")
    table = _placements(groups)
    areas = {r["model"]: r for r in table.groupBy("model").agg(
        F.count("*").alias("scores"),
        (F.sum(F.col("pos") * F.col("v_pos")) / F.sum("pos")).alias("auc")).collect()}
    placed, is_pos = groups.withColumnRenamed("n", "_n"), F.col("target") == 1
    for m in ("1", "2"):
        one = table.where(F.col("model") == m).select(
            F.col("prediction").alias(f"s{m}"), "n", "v_pos", "v_neg")
        placed = lookup_join(placed, one, f"s{m}", ["v_pos", "v_neg"], ["target", "s1", "s2"],
                             stored=True, dim_bytes=areas[m]["scores"] * 72 if m in areas else 0)
        # about the area, which is the mean placement of either class
        placed = placed.withColumn(
            f"v{m}", F.when(is_pos, F.col("v_pos")).otherwise(F.col("v_neg"))
            - F.lit(areas[m]["auc"] if m in areas else None).cast("double")).drop("v_pos", "v_neg")
    w = F.col("_n")
    moments = placed.groupBy("target").agg(
        F.sum(w).alias("m"), F.sum(w * F.col("v1") * F.col("v1")).alias("ss_1"),
        F.sum(w * F.col("v2") * F.col("v2")).alias("ss_2"),
        F.sum(w * F.col("v1") * F.col("v2")).alias("ss_12"))
    spread = F.when(F.col("m") > 1, (F.col("ss_1") + F.col("ss_2") - 2 * F.col("ss_12"))
                    / (F.col("m") - 1) / F.col("m")).otherwise(0.0)
    known = [F.lit(areas[m]["auc"] if m in areas else None).cast("double") for m in ("1", "2")]
    one = moments.agg(F.sum(spread).alias("variance")).select(
        known[0].alias("auc_1"), known[1].alias("auc_2"), "variance")
    delta = F.col("auc_2") - F.col("auc_1")
    moved = F.col("variance") > 0
    z = F.when(moved, delta / F.sqrt(F.greatest(F.col("variance"), F.lit(1e-300)))).otherwise(0.0)
    out = one.select("auc_1", "auc_2", delta.alias("delta"), "variance", z.alias("z"))
    if with_p:
        out = out.withColumn("p_value", two_sided_p(F.col("z")))
    return out
