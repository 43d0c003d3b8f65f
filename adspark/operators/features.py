"""Splitting, temporal and frequency features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from adspark import config
from adspark._checks import require_columns, require_number
from adspark.functions import (
    day_of_month, hour_cos, hour_of_day, hour_sin, log_frequency, split_label, time_band,
)
from adspark.operators.lookup import SALT, lookup_join
from adspark.sources.scratch import materialize


def add_split(
    df: DataFrame,
    id_column: str = "id",
    train_ratio: float = config.TRAIN_RATIO,
    split_column: str = "split",
    train_label: str = config.TRAIN_LABEL,
    holdout_label: str = config.HOLDOUT_LABEL,
    view_name: str | None = None,
) -> DataFrame:
    """Add a train/holdout label that depends on the identifier alone."""
    require_number(train_ratio, "train_ratio", 0, 1)
    require_columns(df, [id_column])
    out = df.withColumn(
        split_column, split_label(id_column, train_ratio, train_label, holdout_label))
    if view_name:
        out.createOrReplaceTempView(view_name)
    return out


def temporal_features(
    df: DataFrame,
    hour: str = "hour",
    id_column: str = "id",
    target: str = config.TARGET,
    bands: tuple[str, ...] = config.TIME_BANDS,
) -> DataFrame:
    """``id, hour_raw, click, day, hour_of_day, hour_sin, hour_cos, time_band``."""
    require_columns(df, [hour, id_column, target])
    return df.select(
        F.col(id_column).alias("id"),
        F.col(hour).alias("hour_raw"),
        F.col(target).alias("click"),
        day_of_month(hour).alias("day"),
        hour_of_day(hour).alias("hour_of_day"),
        hour_sin(hour).alias("hour_sin"),
        hour_cos(hour).alias("hour_cos"),
        time_band(hour, bands).alias("time_band"),
    )


def key_frequencies(df: DataFrame, key: str, exclude=None) -> DataFrame:
    """Rows per key, ``key, n``, leaving out a placeholder key and nulls."""
    kept = df.where(F.col(key).isNotNull())
    if exclude is not None:
        kept = kept.where(F.col(key) != F.lit(exclude))
    return kept.groupBy(key).agg(F.count("*").alias("n"))


def frequencies_in_one_scan(df: DataFrame, keys: Mapping[str, object]) -> list[DataFrame]:
    """``key_frequencies`` of several keys, from one scan; ``keys`` names each one's placeholder or None.

    The rows are stacked, a column per key so that each keeps its type, and counted together.
    One written table, a folder per key, holds the counts.
    """
    require_columns(df, list(keys))
    types = {c: df.schema[c].dataType for c in keys}
    stacked = F.array(*[
        F.struct(F.lit(i).alias("key_no"), *[
            (F.col(k) if k == key else F.lit(None)).cast(types[k]).alias(f"k{j}")
            for j, k in enumerate(keys)])
        for i, key in enumerate(keys)])
    rows = df.select(F.explode(stacked).alias("r")).select("r.*")
    counted = F.lit(False)
    for i, placeholder in enumerate(keys.values()):
        one = (F.col("key_no") == i) & F.col(f"k{i}").isNotNull()
        counted = counted | (one if placeholder is None else one & (F.col(f"k{i}") != F.lit(placeholder)))
    names = ["key_no", *[f"k{i}" for i in range(len(keys))]]
    table = materialize(rows.where(counted).groupBy(*names).agg(F.count("*").alias("n")),
                        "frequencies", partition_by=("key_no",))
    return [table.where(F.col("key_no") == i).select(F.col(f"k{i}").alias(key), "n")
            for i, key in enumerate(keys)]


def attach_frequency(
    df: DataFrame,
    freq: DataFrame,
    key: str,
    name: str,
    placeholder=None,
    spread_by: Sequence[str] = ("id",),
    stored: bool = False,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """Add the frequency of ``key`` as ``name``; absent keys get 0.

    The placeholder, which may fill most of the table, takes no part in the
    join. ``stored`` says that ``freq`` is a written table; ``broadcast_bytes``
    goes to ``lookup_join``.
    """
    hit = None if placeholder is None else F.col(key) == F.lit(placeholder)
    joined = lookup_join(df, freq, key, ["n"], spread_by, no_match=hit, stored=stored,
                         broadcast_bytes=broadcast_bytes)
    return joined.withColumn(name, F.coalesce("n", F.lit(0)).cast("long")).drop("n")


def device_features(
    df: DataFrame,
    id_column: str = "id",
    device_id: str = "device_id",
    device_ip: str = "device_ip",
    placeholder=config.DEVICE_PLACEHOLDER,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Frequencies of the two device keys inside one relation, and their logs.

    Counted and joined back rather than counted in a window per key: a window
    would bring all rows of the most common device to one task.
    """
    require_columns(df, [id_column, device_id, device_ip, *keep])
    rows = df.select(
        F.col(id_column).alias("id"), F.col(device_id).alias("_d"),
        F.col(device_ip).alias("_i"), *keep)
    of_id, of_ip = frequencies_in_one_scan(rows, {"_d": placeholder, "_i": None})
    rows = attach_frequency(rows, of_id, "_d", "freq_device_id", placeholder, stored=True)
    rows = attach_frequency(rows, of_ip, "_i", "freq_device_ip", stored=True)
    return rows.select(
        "id", "freq_device_id", "freq_device_ip",
        log_frequency("freq_device_id").alias("log_freq_device_id"),
        log_frequency("freq_device_ip").alias("log_freq_device_ip"),
        *keep,
    )


def numeric_features(
    df: DataFrame,
    hour: str = "hour",
    id_column: str = "id",
    device_id: str = "device_id",
    device_ip: str = "device_ip",
    placeholder=config.DEVICE_PLACEHOLDER,
) -> DataFrame:
    """Day, cyclic hour and log frequencies, computed without a join on the id."""
    both = device_features(df, id_column, device_id, device_ip, placeholder, keep=[hour])
    return both.select(
        "id",
        day_of_month(hour).alias("day"),
        hour_sin(hour).alias("hour_sin"),
        hour_cos(hour).alias("hour_cos"),
        "log_freq_device_id", "log_freq_device_ip",
    )


def model_features(
    df: DataFrame,
    freq_id: DataFrame,
    freq_ip: DataFrame,
    keep: Sequence[str] = config.CATEGORICAL_COLUMNS,
    id_column: str = "id",
    hour: str = "hour",
    device_id: str = "device_id",
    device_ip: str = "device_ip",
    placeholder=config.DEVICE_PLACEHOLDER,
    target: str = config.TARGET,
    bands: tuple[str, ...] = config.TIME_BANDS,
    extra: Sequence[str] = (),
    stored: bool = False,
    broadcast_bytes: int | None = None,
) -> DataFrame:
    """The modelling table: target, temporal and frequency features, ``keep``.

    The frequency tables come from the training part only. Training rows count
    themselves, keys unseen in training get 0. ``extra`` columns (an identifier,
    a split label) are put in front. ``stored`` says that the frequency tables
    are written tables; they may come from ``bucketed_lookup``.
    """
    require_columns(df, [id_column, hour, device_id, device_ip, target, *keep, *extra])
    used = list(dict.fromkeys([id_column, hour, device_id, device_ip, target, *keep, *extra]))
    rows = df.select(*used)
    def of_key(freq: DataFrame, key: str) -> DataFrame:
        salt = [SALT] if SALT in freq.columns else []
        return freq.select(F.col(freq.columns[0]).alias(key), "n", *salt)

    rows = attach_frequency(rows, of_key(freq_id, device_id), device_id, "_n_id", placeholder,
                            [id_column], stored, broadcast_bytes)
    rows = attach_frequency(rows, of_key(freq_ip, device_ip), device_ip, "_n_ip", None,
                            [id_column], stored, broadcast_bytes)
    return rows.select(
        *extra,
        target,
        day_of_month(hour).alias("day"),
        hour_sin(hour).alias("hour_sin"),
        hour_cos(hour).alias("hour_cos"),
        time_band(hour, bands).alias("time_band"),
        log_frequency("_n_id", F.col(device_id) == F.lit(placeholder)).alias("log_freq_device_id"),
        log_frequency("_n_ip").alias("log_freq_device_ip"),
        *keep,
    )


def split_rates(df: DataFrame, split: str = "split", target: str = config.TARGET) -> DataFrame:
    """Rows and click rate in percent (four decimals) per subset."""
    require_columns(df, [split, target])
    return df.groupBy(split).agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col(target).cast("double")) * 100, 4).alias("ctr_pct"),
    ).orderBy(split)
