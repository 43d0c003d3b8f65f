"""Exact, reproducible samples and folds.

The order is that of an md5 key made of the identifier and a seed. Its leading
hex digits spread rows evenly over buckets whatever the data look like, so the
row at which a sample of ``n`` rows ends is found from bucket counts plus the
rows of one bucket of a stratum; the sample itself is then a plain filter. No
task ever sorts a whole class, and there may be any number of strata.

Rows without an identifier are keyed by a hash of their contents, so they spread over
the buckets like the others; only equal rows share a key. Rows that repeat a key are
ordered by their contents, so samples keep their exact size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from adspark import config
from adspark._checks import require_columns, require_number, require_positive_int
from adspark.functions import order_key
from adspark.operators.lookup import lookup_join
from adspark.sources.scratch import materialize

#: Hex digits of a bucket and of a group of buckets: at most 4,096 groups in a stratum
#: and 4,096 buckets in a group, which bounds every window over them.
DIGITS, GROUP_DIGITS = 6, 3


def _keyed(df: DataFrame, id_column: str, seed: int) -> DataFrame:
    by_row = F.md5(F.concat(F.lit(f"null|{seed}|"), F.to_json(F.struct(*df.columns))))
    return df.withColumn("_key", F.coalesce(order_key(id_column, seed), by_row))


def _bucket() -> Column:
    return F.substring("_key", 1, DIGITS)


def _starts(counts: DataFrame) -> DataFrame:
    """``_s, _p, _n, _before``: the rows of the stratum before each bucket."""
    group = F.substring("_p", 1, GROUP_DIGITS)
    counts = counts.withColumn("_g", group)
    upto = Window.partitionBy("_s").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy("_s", "_g").agg(F.sum("_n").alias("_m")).select(
        F.col("_s").alias("_gs"), F.col("_g").alias("_gg"),
        F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_s", "_g").orderBy("_p").rowsBetween(
        Window.unboundedPreceding, -1)
    same = F.col("_s").eqNullSafe(F.col("_gs")) & (F.col("_g") == F.col("_gg"))
    return counts.withColumn("_b", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(
        groups, same).select("_s", "_p", "_n", (F.col("_start") + F.col("_b")).alias("_before"))


def chosen_rows(keyed: DataFrame, stratum: str | None, quota: Column) -> DataFrame:
    """Adds ``_chosen``: the row is among the first ``quota`` of its stratum, by ``_key``.

    ``quota`` is an expression over ``_size`` (rows of the stratum) and ``_all``
    (rows of the relation). The relation is read twice, once to count.
    """
    names = keyed.columns
    rows = keyed.withColumns({
        # one stratum: a value that is the same in all rows, but no literal, which a join would drop
        "_s": F.col(stratum) if stratum else F.length("_key"), "_p": _bucket()})
    counts = materialize(rows.groupBy("_s", "_p").agg(F.count("*").alias("_n")), "buckets")
    sizes = counts.groupBy("_s").agg(F.sum("_n").alias("_size")).withColumnRenamed("_s", "_z")
    sizes = sizes.withColumn("_all", counts.agg(F.sum("_n")).scalar())
    edges = _starts(counts).join(sizes, F.col("_s").eqNullSafe(F.col("_z"))).withColumn(
        "_quota", F.least(quota.cast("long"), F.col("_size")))
    edges = materialize(
        edges.where((F.col("_before") < F.col("_quota"))
                    & (F.col("_quota") <= F.col("_before") + F.col("_n")))
        .select("_s", F.col("_p").alias("_edge"), "_size",
                (F.col("_quota") - F.col("_before")).alias("_left")), "edges")
    rows = lookup_join(rows, edges, "_s", ["_edge", "_left"], spread_by=["_key"],
                       weight="_size", null_matches=True, stored=True)
    at = F.coalesce(F.col("_p") == F.col("_edge"), F.lit(False))
    order = Window.partitionBy("_s").orderBy("_key", F.to_json(F.struct(*names)))
    edge = rows.where(at).withColumn("_chosen", F.row_number().over(order) <= F.col("_left"))
    rest = rows.where(~at).withColumn(
        "_chosen", F.coalesce(F.col("_p") < F.col("_edge"), F.lit(False)))
    return edge.unionByName(rest).select(*names, "_chosen")


def stratified_sample(
    df: DataFrame,
    n: int,
    target: str = config.TARGET,
    id_column: str = "id",
    seed: int = 42,
) -> DataFrame:
    """``n`` rows that keep the class proportions, each class sampled exactly.

    A class of ``c`` rows out of ``N`` contributes ``max(1, round(n c / N))``
    rows, halves rounding to even. ``n`` must be below ``N``.
    """
    require_positive_int(n, "n")
    require_columns(df, [target, id_column])
    keyed = _keyed(df, id_column, seed)
    share = F.bround(F.lit(float(n)) * F.col("_size") / F.col("_all"), 0)
    quota = F.when(
        F.lit(n) >= F.col("_all"),
        F.raise_error(F.lit("'n' must be smaller than the number of rows")).cast("double"),
    ).otherwise(F.greatest(F.lit(1.0), share))
    return chosen_rows(keyed, target, quota).where("_chosen").select(*df.columns)


def row_sample(df: DataFrame, n: int, id_column: str = "id", seed: int = 42) -> DataFrame:
    """``n`` rows in key order, or all rows when there are fewer."""
    require_positive_int(n, "n")
    require_columns(df, [id_column])
    keyed = _keyed(df, id_column, seed)
    return chosen_rows(keyed, None, F.lit(n)).where("_chosen").select(*df.columns)


def train_valid_split(
    df: DataFrame,
    valid_ratio: float = 0.2,
    target: str = config.TARGET,
    id_column: str = "id",
    seed: int = 42,
    name: str = "part",
) -> DataFrame:
    """Add ``name``: "valid" for the given share of each class, else "train"."""
    require_number(valid_ratio, "valid_ratio", 0, 1)
    require_columns(df, [target, id_column])
    keyed = _keyed(df, id_column, seed)
    rows = chosen_rows(keyed, target, F.bround(F.lit(float(valid_ratio)) * F.col("_size"), 0))
    return rows.select(*df.columns, F.when(F.col("_chosen"), "valid").otherwise("train").alias(name))


def stratified_folds(
    df: DataFrame,
    num_folds: int = 5,
    target: str = config.TARGET,
    id_column: str = "id",
    seed: int = 42,
    exact: bool = True,
    name: str = "fold",
) -> DataFrame:
    """Add a fold number; fold sizes per class differ by at most one.

    Rows are numbered inside their class and dealt round. The window that
    numbers them works on (class, key prefix) groups, which the hash keeps
    small; ``exact=False`` takes the hash modulo ``num_folds`` instead, which
    needs no shuffle and balances approximately.
    """
    require_positive_int(num_folds, "num_folds")
    if num_folds < 2:
        raise ValueError("'num_folds' must be at least 2")
    require_columns(df, [target, id_column])
    keyed = _keyed(df, id_column, seed)
    if not exact:
        number = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
        return keyed.withColumn(
            name, F.pmod(number, F.lit(num_folds)).cast("int")).drop("_key")
    # a text for every class, null included, so that window and join share one shuffle
    label = F.coalesce(F.concat(F.lit("="), F.col(target).cast("string")), F.lit("null"))
    keyed = keyed.withColumns({"_s": label, "_p": _bucket()})
    counts = materialize(keyed.groupBy("_s", "_p").agg(F.count("*").alias("_n")), "buckets")
    inside = Window.partitionBy("_s", "_p").orderBy("_key", F.to_json(F.struct(*df.columns)))
    ranked = keyed.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(_starts(counts), ["_s", "_p"]).select(
        *df.columns,
        F.pmod(F.col("_before") + F.col("_rank"), F.lit(num_folds)).cast("int").alias(name))


def class_counts(df: DataFrame, target: str = config.TARGET) -> DataFrame:
    """``target, n, proportion`` per class."""
    require_columns(df, [target])
    counts = df.groupBy(F.col(target).alias("target")).agg(F.count("*").alias("n"))
    return counts.select(
        "target", "n", (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("proportion"))


def sample_summary(
    source: DataFrame,
    sample: DataFrame,
    target: str = config.TARGET,
    labels: tuple[str, str] = ("Original", "Sample"),
) -> DataFrame:
    """``set, records, rate, delta`` of a relation and of a sample of it."""
    if len(labels) != 2:
        raise ValueError("'labels' must hold two names")

    def one(df: DataFrame, label: str) -> DataFrame:
        rate = F.avg(F.when(F.col(target) == 1, 1.0).otherwise(0.0))
        return df.agg(F.count("*").alias("records"), rate.alias("rate")).select(
            F.lit(label).alias("set"), "records", "rate")

    base = one(source, labels[0])
    drawn = one(sample, labels[1])
    delta = F.col("rate") - base.select("rate").scalar()
    return base.withColumn("delta", F.lit(None).cast("double")).unionByName(
        drawn.withColumn("delta", delta))


def draw_cases(df: DataFrame, condition: Column, k: int = 1, id_column: str = "id",
               seed: int = 42) -> DataFrame:
    """``k`` rows that meet ``condition``, chosen by key order."""
    require_positive_int(k, "k")
    return _keyed(df.where(condition), id_column, seed).orderBy("_key").limit(k).drop("_key")
