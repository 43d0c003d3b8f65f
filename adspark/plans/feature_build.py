"""The end-to-end feature build."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from adspark import config
from adspark.operators.features import (
    add_split, frequencies_in_one_scan, model_features, split_rates,
)
from adspark.operators.lookup import bucketed_lookup
from adspark.sources.writers import write_subsets


@dataclass
class FeatureBuild:
    """What a feature build yields."""

    features: DataFrame
    freq_id: DataFrame
    freq_ip: DataFrame
    rates: DataFrame

    def subset(self, label: str) -> DataFrame:
        """The modelling table of one subset, without identifier and label."""
        return self.features.where(F.col("split") == label).drop("split", "id")


def build_features(
    df: DataFrame,
    keep: Sequence[str] = config.CATEGORICAL_COLUMNS,
    id_column: str = "id",
    train_ratio: float = config.TRAIN_RATIO,
    train_label: str = config.TRAIN_LABEL,
    holdout_label: str = config.HOLDOUT_LABEL,
    placeholder=config.DEVICE_PLACEHOLDER,
    target: str = config.TARGET,
    bands: tuple[str, ...] = config.TIME_BANDS,
    bucketed: bool = False,
    broadcast_bytes: int | None = None,
) -> FeatureBuild:
    """Split by hash, count devices on the training part, derive all features.

    The two frequency tables are counted on the training rows in one scan and written to
    the scratch folder; everything else is one lazy plan for both subsets, and
    nothing else in the features looks beyond its own row. ``bucketed`` writes them in
    buckets of their keys, so that joins too large for a broadcast (beyond ``broadcast_bytes``)
    shuffle the rows only.
    """
    marked = add_split(df, id_column, train_ratio, "split", train_label, holdout_label)
    train = marked.where(F.col("split") == train_label)
    freq_id, freq_ip = frequencies_in_one_scan(
        train, {"device_id": placeholder, "device_ip": None})
    if bucketed:
        freq_id = bucketed_lookup(freq_id, "device_id", ["n"])
        freq_ip = bucketed_lookup(freq_ip, "device_ip", ["n"])
    features = model_features(
        marked, freq_id, freq_ip, keep, id_column, placeholder=placeholder,
        target=target, bands=bands, extra=[id_column, "split"], stored=True,
        broadcast_bytes=broadcast_bytes)
    if id_column != "id":
        features = features.withColumnRenamed(id_column, "id")
    return FeatureBuild(features, freq_id, freq_ip, split_rates(marked, "split", target))


def run_feature_build(df: DataFrame, output: str, **options) -> FeatureBuild:
    """Build the features and write both subsets in one pass, by split."""
    built = build_features(df, **options)
    write_subsets(built.features, output)
    return built
