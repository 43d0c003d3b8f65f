"""Running totals over a total order, without a single-task window.

``Window.orderBy`` without a partition moves every row to one task. Here the key
range is cut into buckets at approximate quantiles, each bucket is summed in its
own task, and a bucket's offset is the sum of the buckets before it. The cut
points are literals in the plan, so the bucket of a key never changes when a
task runs again; they only balance the work and do not affect the result.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

MIN_BUCKETS = 64
#: Distinct keys that a bucket is meant to hold; one task sorts a bucket.
KEYS_PER_BUCKET = 500_000


def buckets_for(df: DataFrame) -> int:
    """Buckets for a table of distinct keys, by their number."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_BUCKETS, wanted, math.ceil(df.count() / KEYS_PER_BUCKET))


def cut_points(df: DataFrame, key: str, buckets: int | None = None) -> list[float]:
    """Distinct approximate quantiles of ``key``, at most ``buckets - 1`` numbers.

    A mergeable sketch per task; only the quantiles reach the driver. ``df``
    should hold distinct keys, so that buckets are even in distinct keys; with
    repeated keys several quantiles may coincide and are kept once.
    """
    if buckets is None:
        buckets = buckets_for(df)
    probs = [i / buckets for i in range(1, buckets)]
    found = df.select(F.col(key).cast("double").alias("v")).approxQuantile(
        "v", probs, 0.25 / buckets)
    return sorted({float(x) for x in found if x == x})


def text_cut_points(df: DataFrame, key: str, buckets: int | None = None,
                    per_bucket: int = 16) -> list[str]:
    """Cut points for text keys, from a hash-ordered sample of a few keys a bucket.

    ``df`` holds distinct keys. ``buckets x per_bucket`` of them reach the
    driver, where every ``per_bucket``-th in sorted order becomes a cut point.
    """
    buckets = buckets_for(df) if buckets is None else buckets
    seen = df.select(key).where(F.col(key).isNotNull()).orderBy(
        F.xxhash64(key), key).limit(buckets * per_bucket).collect()
    keys = sorted({r[0] for r in seen})
    return keys[per_bucket::per_bucket]


def with_bucket(df: DataFrame, key: str, cuts: Sequence[float] | Sequence[str],
                name: str = "_bucket") -> DataFrame:
    """Add the bucket number of ``key``; null and NaN share the last bucket."""
    if cuts and isinstance(cuts[0], str):
        listed = F.array(*[F.lit(c) for c in cuts])
        place = F.size(F.filter(listed, lambda c: c <= F.col(key)))
        return df.withColumn(
            name, F.when(F.col(key).isNull(), len(cuts) + 1).otherwise(place))
    splits = [float("-inf"), *cuts, float("inf")]
    if len(splits) < 3:
        last = F.col(key).isNull()
        if dict(df.dtypes)[key] in ("double", "float"):
            last = last | F.isnan(key)
        return df.withColumn(name, F.when(last, 1).otherwise(0))
    ready = df.withColumn("_bucket_key", F.col(key).cast("double"))
    return (
        Bucketizer(splits=splits, inputCol="_bucket_key", outputCol=name,
                   handleInvalid="keep")
        .transform(ready).drop("_bucket_key")
        .withColumn(name, F.coalesce(F.col(name).cast("int"), F.lit(len(splits) - 1)))
    )


def running_totals(
    df: DataFrame,
    key: str,
    sums: Sequence[str],
    cuts: Sequence[float] | Sequence[str],
    by: Sequence[str] = (),
) -> DataFrame:
    """Add ``<s>_below`` and ``<s>_total`` for every column in ``sums``.

    ``df`` holds one row per ``(by, key)``; ``<s>_below`` sums ``s`` over the
    smaller keys of the same ``by`` group (nulls order last) and ``<s>_total``
    over the whole group. ``by`` columns hold no nulls. The offset table has
    ``groups x (cuts + 2)`` rows and is joined on the partitioning that the
    running sums have already.
    """
    by = list(by)
    placed = with_bucket(df, key, cuts)
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(F.col(key).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    groups = Window.partitionBy(*by)
    earlier = groups.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*by, "_bucket").agg(
        *[F.sum(s).alias(f"_b_{s}") for s in sums])
    offsets = offsets.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_b_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_b_{s}").over(groups).alias(f"{s}_total") for s in sums],
    )
    run = placed.select(
        "*", *[(F.sum(s).over(inside) - F.col(s)).alias(f"_r_{s}") for s in sums])
    # both sides are partitioned by the join keys already: no further shuffle
    return run.join(offsets, [*by, "_bucket"]).select(
        *df.columns,
        *[(F.col(f"_r_{s}") + F.col(f"_o_{s}")).alias(f"{s}_below") for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )
