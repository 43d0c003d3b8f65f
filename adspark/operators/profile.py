"""Descriptive profiles of a relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from adspark import config
from adspark._checks import (
    require_choice, require_columns, require_names, require_number,
    require_positive_int, require_rows,
)
from adspark.functions import level_label, list_position
from adspark.operators.levels import dominant_levels, level_counts

METRICS = ("clicks", "impressions", "ctr")


def preview(df: DataFrame, limit: int = 5, order_by: Sequence[str] = (),
            check_empty: bool = False) -> DataFrame:
    """The first ``limit`` rows, in the given order when a stable answer is needed."""
    require_positive_int(limit, "limit")
    if check_empty:
        require_rows(df)
    return (df.orderBy(*order_by) if order_by else df).limit(limit)


def integrity(df: DataFrame) -> DataFrame:
    """``position, column, dtype, n_missing`` for every column, in one pass."""
    names = df.columns
    nulls = df.agg(*[
        F.coalesce(F.sum(F.col(f"`{c}`").isNull().cast("long")), F.lit(0)).alias(f"m{i}")
        for i, c in enumerate(names)
    ])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                 F.lit(t).alias("dtype"), F.col(f"m{i}").alias("n_missing"))
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return nulls.select(F.explode(rows).alias("r")).select("r.*").orderBy("position")


def cardinality(df: DataFrame, columns: Sequence[str], approx: bool = False,
                log2_size: int = 12, sort_descending: bool = True) -> DataFrame:
    """``column, n_distinct`` without nulls.

    The exact form counts the levels of all columns in one scan. The approximate
    form keeps one sketch of ``2**log2_size`` registers per column and task and
    shuffles only sketches.
    """
    columns = require_names(columns)
    require_columns(df, columns)
    if approx:
        one = df.agg(*[
            F.hll_sketch_estimate(F.hll_sketch_agg(F.col(c).cast("string"), log2_size)).alias(c)
            for c in columns])
        out = one.unpivot([], columns, "column", "n_distinct")
    else:
        found = level_counts(df, columns).groupBy("column").agg(
            F.count("level").alias("n_distinct"))
        out = found
    if sort_descending:
        out = out.orderBy(F.desc("n_distinct"), "column")
    return out


def level_distribution(
    df: DataFrame,
    column: str,
    n: float | None = None,
    level_mapping: Mapping | None = None,
    sort_descending: bool = True,
    check_empty: bool = False,
) -> DataFrame:
    """``level, count, percentage, label``; null is a level.

    The percentage is of the relation's own rows, or of ``n`` when given (then
    it need not sum to 100).
    """
    require_columns(df, [column])
    if n is not None and (isinstance(n, bool) or not isinstance(n, (int, float)) or n <= 0):
        raise ValueError("'n' must be None or a positive number")
    if check_empty:
        require_rows(df)
    counts = df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("count"))
    whole = F.lit(float(n)) if n is not None else counts.agg(F.sum("count")).scalar()
    out = counts.select(
        "level", "count",
        (F.col("count") * F.lit(100.0) / whole).alias("percentage"),
        level_label("level", level_mapping).alias("label"),
    )
    if sort_descending:
        out = out.orderBy(F.desc("percentage"), F.asc_nulls_last("level"))
    return out


def level_distribution_pair(
    relations: tuple[DataFrame, DataFrame],
    columns: tuple[str, str],
    n: tuple[float | None, float | None] = (None, None),
    level_mappings: tuple[Mapping | None, Mapping | None] = (None, None),
    panels: tuple[str, str] = ("left", "right"),
) -> DataFrame:
    """Two distributions with their own denominators, told apart by ``panel``."""
    if len(relations) != 2 or len(columns) != 2:
        raise ValueError("two relations and two columns are needed")
    parts = [
        level_distribution(d, c, m, lm, sort_descending=False).select(
            F.lit(p).alias("panel"), F.col("level").cast("string").alias("level"),
            "count", "percentage", "label")
        for d, c, m, lm, p in zip(relations, columns, n, level_mappings, panels)
    ]
    return parts[0].unionByName(parts[1]).orderBy(
        "panel", F.desc("percentage"), F.asc_nulls_last("level"))


def coverage(
    df: DataFrame,
    columns: Sequence[str],
    thresholds: Sequence[float] = (0.90, 0.80, 0.70, 0.60),
    ties: str = "peers",
    sort_ascending: bool = True,
) -> DataFrame:
    """Levels needed to cover each share of the rows, one row per column.

    Output columns are ``column`` and ``t0, t1, ...`` in threshold order. With
    ``ties="peers"`` levels of equal count share their cumulative share, as a
    running sum with the default window frame does; ``ties="rows"`` counts them
    one by one and gives the true minimum.

    Levels are grouped by their count before any ordering: different counts sum
    to at most the number of rows, so ``N`` rows have fewer than ``sqrt(2 N)``
    of them, even when nearly every row has a level of its own.
    """
    columns = require_names(columns)
    if not thresholds:
        raise ValueError("'thresholds' must not be empty")
    for t in thresholds:
        require_number(t, "thresholds", 0, 1)
    require_choice(ties, "ties", ("peers", "rows"))
    steps = level_counts(df, columns).groupBy("column", "n").agg(F.count("*").alias("k"))
    return _coverage_of_steps(steps, thresholds, ties, sort_ascending)


def _coverage_of_steps(steps: DataFrame, thresholds: Sequence[float], ties: str,
                       sort_ascending: bool = True) -> DataFrame:
    down = Window.partitionBy("column").orderBy(F.desc("n"))
    whole = Window.partitionBy("column")
    upto = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = F.col("n") * F.col("k")
    ranked = steps.select(
        "column", "n", "k",
        (F.sum("k").over(upto) - F.col("k")).alias("levels_before"),
        (F.sum(mass).over(upto) - mass).alias("mass_before"),
        F.sum(mass).over(whole).alias("total"),
    )
    total = F.col("total").cast("double")

    def share(levels: Column) -> Column:
        return (F.col("mass_before") + levels * F.col("n")).cast("double") / total

    def needed(t: float) -> Column:
        if ties == "peers":
            inside = F.lit(1).cast("long")
        else:
            # solved in floating point, then moved by one step if rounding missed
            guess = F.greatest(F.lit(1).cast("long"), F.ceil(
                (F.lit(t) * total - F.col("mass_before")) / F.col("n")))
            inside = (
                F.when((guess > 1) & (share(guess - 1) >= t), guess - 1)
                .when(share(guess) < t, guess + 1).otherwise(guess)
            )
        return F.min(F.when(share(F.col("k")) >= t, F.col("levels_before") + inside))

    out = ranked.groupBy("column").agg(
        *[needed(float(t)).alias(f"t{i}") for i, t in enumerate(thresholds)])
    order = F.asc_nulls_last("t0") if sort_ascending else F.desc_nulls_last("t0")
    return out.orderBy(order, "column")


def split_summary(
    df: DataFrame,
    split: str = "split",
    target: str = config.TARGET,
    target_labels: Mapping | None = None,
    split_labels: Mapping | None = None,
    total_label: str = "Total",
) -> DataFrame:
    """``split, level, n, pct``: target levels within each subset, and totals.

    ``pct`` is the share within the subset; on the total rows it is the subset's
    share of all rows. Levels absent from a subset appear with 0, and so do listed
    subsets that the relation lacks. A null level or subset is one of its own. With
    label maps only the listed levels and subsets appear, as their labels; the
    shares still refer to all rows.
    """
    require_columns(df, [split, target])
    # cells, subsets and the whole from one scan: a rollup, whose grouping_id tells them apart
    rolled = df.select(
        F.col(split).cast("string").alias("split"), F.col(target).cast("string").alias("level"),
    ).rollup("split", "level").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    # subsets and levels are few: their counts fit a row, and every listed pair is a cell
    one = rolled.agg(F.collect_list(F.struct("split", "level", "n", "g")).alias("c"))

    def listed(labels: Mapping | None, name: str, kind: int) -> Column:
        if labels:
            return F.array(*[F.lit(str(k)) for k in labels])
        return F.array_distinct(F.transform(
            F.filter("c", lambda x: x["g"] == kind), lambda x: x[name]))

    def count_of(kind: int, *same: tuple[str, Column]) -> Column:
        def hit(x: Column) -> Column:
            out = x["g"] == kind
            for name, value in same:
                out = out & x[name].eqNullSafe(value)
            return out
        return F.coalesce(F.get(F.filter("c", hit), F.lit(0))["n"], F.lit(0).cast("long"))

    subsets = one.select("c", listed(target_labels, "level", 0).alias("levels"),
                         F.explode(listed(split_labels, "split", 1)).alias("s"))
    subsets = subsets.withColumns({
        "split_n": count_of(1, ("split", F.col("s"))), "all_n": count_of(3)})
    rows = subsets.select("*", F.explode(F.concat(
        F.transform("levels", lambda v: F.struct(v.alias("v"), F.lit(False).alias("total"))),
        F.array(F.struct(F.lit(None).cast("string").alias("v"), F.lit(True).alias("total"))),
    )).alias("cell")).select("*", "cell.v", "cell.total")
    n = F.when(F.col("total"), F.col("split_n")).otherwise(
        count_of(0, ("split", F.col("s")), ("level", F.col("v"))))
    whole = F.nullif(F.when(F.col("total"), F.col("all_n")).otherwise(F.col("split_n")),
                     F.lit(0).cast("long"))
    pct = F.lit(100.0) * n / whole
    return rows.select(
        level_label("s", split_labels).alias("split"),
        F.when(F.col("total"), F.lit(total_label)).otherwise(
            level_label("v", target_labels)).alias("level"),
        n.alias("n"),
        F.when(F.col("total"), pct).otherwise(F.coalesce(pct, F.lit(0.0))).alias("pct"),
    ).orderBy("split", "level")


def _metric(metric: str, target: str) -> Column:
    if metric == "clicks":
        return F.sum(F.when(F.col(target) == 1, 1).otherwise(0)).cast("double")
    if metric == "impressions":
        return F.count("*").cast("double")
    return F.avg(F.col(target).cast("double")) * 100.0


def rate_by_hour(df: DataFrame, hour: str = "hour_of_day",
                 target: str = config.TARGET) -> DataFrame:
    """``hour, ctr, n``: click rate in percent and rows per hour of day."""
    require_columns(df, [hour, target])
    return df.groupBy(F.col(hour).alias("hour")).agg(
        (F.avg(F.col(target).cast("double")) * 100.0).alias("ctr"),
        F.count("*").alias("n"),
    ).orderBy("hour")


def metric_by_level(
    df: DataFrame,
    column: str,
    metric: str = "ctr",
    target: str = config.TARGET,
    order: Sequence[str] | None = None,
) -> DataFrame:
    """``level, value`` for one metric, in natural or in the given order."""
    require_choice(metric, "metric", METRICS)
    require_columns(df, [column, target])
    out = df.groupBy(F.col(column).alias("level")).agg(_metric(metric, target).alias("value"))
    if order is None:
        return out.orderBy("level")
    return out.orderBy(list_position(F.col("level").cast("string"), order), "level")


def temporal_overview(
    df: DataFrame,
    metric: str = "ctr",
    target: str = config.TARGET,
    day_column: str = "day",
    band_column: str = "time_band",
    band_order: Sequence[str] | None = config.TIME_BANDS,
) -> DataFrame:
    """``panel, position, level, value`` per day and per time band, in one scan."""
    require_choice(metric, "metric", METRICS)
    require_columns(df, [day_column, band_column, target])
    counts = level_counts(df, [day_column, band_column], target)
    value = {
        "clicks": F.col("pos").cast("double"),
        "impressions": F.col("n").cast("double"),
        "ctr": F.col("pos") / F.col("n") * 100.0,
    }[metric]
    is_day = F.col("column") == day_column
    place = F.lit(0) if band_order is None else list_position("level", band_order)
    w = Window.partitionBy("column").orderBy(
        F.when(is_day, F.lit(0)).otherwise(place),
        F.when(is_day, F.col("level").try_cast("int")), "level")
    return counts.select(
        F.when(is_day, "day").otherwise("band").alias("panel"),
        F.row_number().over(w).alias("position"), "level", value.alias("value"),
    ).orderBy("panel", "position")


def histogram(
    df: DataFrame,
    columns: Sequence[str],
    bins: int = 50,
    positive_only: bool = False,
    check_empty: bool = False,
) -> DataFrame:
    """Equal-width bins over each column's range: ``column, bin, lo, hi, count``.

    Every bin is ``[lo, hi)`` but the last, which is closed; empty bins are
    listed. A constant column gets a range of width one around its value.
    ``positive_only`` drops values up to 0 first, as a logarithmic axis needs.
    Nulls and NaN are left out.
    """
    columns = require_names(columns)
    require_positive_int(bins, "bins")
    require_columns(df, columns)
    if check_empty:
        require_rows(df)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    if positive_only:
        values = values.where(F.col("v") > 0)
    # one row per column, so the broadcasts below are as long as the argument list
    spans = values.groupBy("column").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    spans = spans.select(
        "column",
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )

    def edge(i: Column) -> Column:
        return F.col("lo") + i * (F.col("hi") - F.col("lo")) / bins

    guess = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins),
                    F.lit(bins - 1)).cast("int")
    g = F.col("g")
    placed = values.join(F.broadcast(spans), "column").withColumn("g", guess).select(
        "column",
        F.when((g > 0) & (F.col("v") < edge(g)), g - 1)
        .when((g < bins - 1) & (F.col("v") >= edge(g + 1)), g + 1)
        .otherwise(g).alias("bin"),
    )
    counts = placed.groupBy("column", "bin").agg(F.count("*").alias("count"))
    grid = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    b = F.col("bin")
    return grid.join(counts, ["column", "bin"], "left").select(
        "column", "bin",
        edge(b).alias("bin_lo"),
        F.when(b == bins - 1, F.col("hi")).otherwise(edge(b + 1)).alias("bin_hi"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"),
    ).orderBy("column", "bin")


def suggest_encoding(
    df: DataFrame,
    columns: Sequence[str],
    single_share: float = 0.75,
    top_share: float = 0.90,
    max_top: int = 10,
    max_levels: int = 100,
    hybrid_share: float = 0.30,
) -> DataFrame:
    """Encoding strategy per column: ``column, n_levels, dominant_share, strategy, k``.

    * one level covers ``single_share`` of the rows: ``dichotomize``
    * ``top_share`` is reached within ``max_top`` levels, or there are at most
      ``max_levels`` levels: ``top_k`` with ``k`` levels, ``max_top`` at most
    * the dominant level covers ``hybrid_share``: ``hybrid``
    * otherwise: ``target_rate``
    """
    columns = require_names(columns)
    for name, value in (("single_share", single_share), ("top_share", top_share),
                        ("hybrid_share", hybrid_share)):
        require_number(value, name, 0, 1)
    counts = level_counts(df, columns)
    size = counts.groupBy("column").agg(
        F.count("level").alias("n_levels"), F.sum("n").alias("rows"))
    steps = counts.groupBy("column", "n").agg(F.count("*").alias("k"))
    cover = _coverage_of_steps(steps, [top_share], "rows").select(
        "column", F.col("t0").alias("needed"))
    top = dominant_levels(counts).select("column", F.col("n").alias("top_n"))
    share = F.col("top_n") / F.col("rows")
    few = (F.col("needed") <= max_top) | (F.col("n_levels") <= max_levels)
    strategy = (
        F.when(share >= single_share, "dichotomize").when(few, "top_k")
        .when(share >= hybrid_share, "hybrid").otherwise("target_rate")
    )
    # three tables with one row per listed column
    return (
        size.join(cover, "column").join(top, "column")
        .select("column", "n_levels", share.alias("dominant_share"),
                strategy.alias("strategy"),
                F.when(strategy == "top_k", F.least("needed", F.lit(max_top)))
                .cast("int").alias("k"))
        .orderBy("column")
    )
