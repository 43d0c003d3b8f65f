"""Attach values of a keyed table to a large table whose keys are skewed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from adspark.sources.scratch import materialize, materialize_bucketed

#: Column of a bucketed lookup table that stands beside its key; see ``bucketed_lookup``.
SALT = "_salt"
#: Bytes of a lookup table up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def table_bytes(dim: DataFrame, key: str, n_values: int) -> int:
    """Bytes of a lookup table's keys and of ``n_values`` numbers a row, as a broadcast holds it."""
    row = dim.agg(F.count("*").alias("n"),
                  F.sum(F.octet_length(F.col(key).cast("string"))).alias("b")).first()
    return int(row["b"] or 0) + row["n"] * (32 + 16 * n_values)


def bucketed_lookup(dim: DataFrame, key: str, values: Sequence[str], weight: str = "n",
                    buckets: int | None = None) -> DataFrame:
    """Write a lookup table so that ``lookup_join`` never shuffles it.

    It is bucketed by what the shuffled join compares, the key and a salt, which is 0 in the
    lookup. A table that many joins look into (the features of every subset, every
    smoothing value) is then shuffled once, when it is written.
    """
    columns = list(dict.fromkeys([key, weight, *values]))
    return materialize_bucketed(
        dim.select(*columns, F.lit(0).cast("long").alias(SALT)), "buckets", [SALT, key], buckets)


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    values: Sequence[str],
    spread_by: Sequence[str],
    weight: str = "n",
    no_match: Column | None = None,
    null_matches: bool = False,
    stored: bool = False,
    hot_keys: int | None = None,
    broadcast_bytes: int | None = None,
    dim_bytes: int | None = None,
) -> DataFrame:
    """Left join ``facts`` with ``dim`` (one row per ``key``) on ``key``.

    ``dim`` is written to the scratch folder first (unless ``stored`` says it is
    a written table already), so it is computed once and its size can be taken.
    Up to ``broadcast_bytes`` (``BROADCAST_BYTES`` unless given) it is broadcast.
    Beyond that both sides are shuffled by key, with hot keys taken out of the way:

    a key that ``facts`` holds in more than ``1/hot_keys`` of its rows is hot,
    whether ``dim`` knows it or not; by default that is the share of one shuffle
    partition. There are fewer than ``hot_keys`` of them, whatever the size of
    the data, and they are broadcast with their values. Rows with a hot key, rows
    that ``no_match`` marks as having no entry, and rows with a null key then need
    no partner from the shuffled join, so their join key is replaced by a hash of
    ``spread_by`` and the other columns: they are spread evenly instead of meeting in
    one task. ``weight`` is a column of ``dim`` that is kept with it. A ``dim`` that
    ``bucketed_lookup`` wrote is read in its buckets and not shuffled. ``dim_bytes``
    is its size, where that is known.
    """
    stored = stored or SALT in dim.columns
    if not stored:
        dim = materialize(dim.select(*dict.fromkeys([key, weight, *values])), "lookup")
    limit = BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    if limit and dim_bytes is None:
        dim_bytes = table_bytes(dim, key, len(values))
    if limit and dim_bytes <= limit:
        return _small_join(facts, dim, key, values, null_matches)
    if hot_keys is None:
        hot_keys = max(2, int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _salted_join(facts, dim, key, values, spread_by, no_match, null_matches, hot_keys)


def _matches(key: str, other: str, null_matches: bool) -> Column:
    if null_matches:
        return F.col(key).eqNullSafe(F.col(other))
    return F.col(key) == F.col(other)


def _small_join(facts: DataFrame, dim: DataFrame, key: str, values: Sequence[str],
                null_matches: bool) -> DataFrame:
    small = dim.select(F.col(key).alias("_dim_key"), *values)
    joined = facts.join(
        F.broadcast(small), _matches(key, "_dim_key", null_matches), "left")
    return joined.select(*facts.columns, *values)


def _salted_join(facts: DataFrame, dim: DataFrame, key: str, values: Sequence[str],
                 spread_by: Sequence[str], no_match: Column | None,
                 null_matches: bool, hot_keys: int) -> DataFrame:
    counts = facts.groupBy(F.col(key).alias("_hot_key")).agg(F.count("*").alias("_facts"))
    total = facts.count()
    often = materialize(counts.where(F.col("_facts") * hot_keys > total), "hot-keys")
    known = dim.select(F.col(key).alias("_dim_key"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    # one row per hot key on the left
    hot = often.join(known, _matches("_hot_key", "_dim_key", null_matches), "left").select(
        "_hot_key", F.lit(True).alias("_hot"), *[f"_hot_{v}" for v in values])
    marked = facts.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot_key")), "left")

    hashable = [c for c, t in facts.dtypes if "map<" not in t]
    spread = list(dict.fromkeys([*spread_by, *hashable]))
    alone = F.coalesce(F.col("_hot"), F.lit(False))
    if not null_matches:
        alone = alone | F.col(key).isNull()
    if no_match is not None:
        alone = alone | F.coalesce(no_match, F.lit(False))
    salt = F.when(alone, F.xxhash64(*spread)).otherwise(F.lit(0).cast("long"))
    cold_values = [F.col(v).alias(f"_cold_{v}") for v in values]
    if SALT in dim.columns:
        marked = marked.withColumn("_join_key_salt", salt)
        cold = dim.select(F.col(SALT).alias("_cold_salt"), F.col(key).alias("_cold_key"),
                          *cold_values)
        same = (F.col("_join_key_salt") == F.col("_cold_salt")) & _matches(
            key, "_cold_key", null_matches)
    else:
        # one struct: a literal salt beside the key would be folded out of the join keys
        marked = marked.withColumn("_join_key", F.struct(salt.alias("s"), F.col(key).alias("k")))
        cold = dim.select(F.struct(
            F.lit(0).cast("long").alias("s"), F.col(key).alias("k")).alias("_dim_key"), *cold_values)
        same = F.col("_join_key") == F.col("_dim_key")
    # too large to broadcast, as its size has shown
    joined = marked.join(cold.hint("merge"), same, "left")
    return joined.select(
        *facts.columns,
        *[F.coalesce(F.col(f"_hot_{v}"), F.col(f"_cold_{v}")).alias(v) for v in values],
    )
