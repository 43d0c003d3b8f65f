"""Leak-free encoding of categorical and numeric columns.

``ImpressionEncoder.fit`` makes one pass over the training rows that counts the
levels of all categorical columns. Dominant levels, top-K lists, one-hot levels
and target rates all follow from that small table. The fitted object is an
ordinary ``PipelineModel`` whose last stage yields ``features``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable,
    DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adspark._checks import require_columns
from adspark.config import DERIVED, OTHER, EncodingConfig
from adspark.operators.levels import level_counts, top_levels
from adspark.operators.lookup import bucketed_lookup, lookup_join
from adspark.operators.prefix import running_totals, text_cut_points
from adspark.sources.scratch import materialize


def config_to_json(config: EncodingConfig) -> str:
    """Text form of a configuration, for persistence."""
    return json.dumps(asdict(config))


def config_from_json(text: str) -> EncodingConfig:
    """Inverse of ``config_to_json``."""
    raw = json.loads(text)
    return EncodingConfig(**{
        k: tuple(v) if isinstance(v, list) else v for k, v in raw.items()})


def is_dominant(column: str, level: str | None) -> Column:
    """1.0 on rows that hold the dominant level."""
    return F.when(F.col(column).cast("string").eqNullSafe(F.lit(level)), 1.0).otherwise(0.0)


def top_or_other(column: str, levels: Sequence[str], other: str = OTHER) -> Column:
    """The level when it is one of ``levels``, else ``other``."""
    text = F.col(column).cast("string")
    return F.when(text.isin(list(levels)), text).otherwise(other)


class LevelEncoderModel(Model, MLReadable, MLWritable):
    """Adds the encoded columns to a table.

    ``<c>_is_dominant`` flags, ``<c>_top`` collapsed levels and ``<c>_te`` rates.
    The state a transform needs from the driver is short (one level per flagged
    column, K per collapsed one); rates stay in a table.
    """

    def __init__(self, config: EncodingConfig | None = None,
                 state: dict | None = None, counts: DataFrame | None = None):
        super().__init__()
        self.config = config or EncodingConfig()
        self.state = state or {}
        self.counts = counts
        self.buckets: dict[str, DataFrame] = {}
        self.broadcast_bytes: int | None = None

    def with_bucketed_rates(self, broadcast_bytes: int | None = None) -> LevelEncoderModel:
        """The same model with its rates written in buckets, for many large tables to look up."""
        out = LevelEncoderModel(self.config, self.state, self.counts)
        out.broadcast_bytes = broadcast_bytes
        out.buckets = {c: bucketed_lookup(
            self.rates(c).withColumnRenamed("level", "_level"), "_level", ["rate"])
            for c in self.rate_columns}
        return out

    @property
    def rate_columns(self) -> tuple[str, ...]:
        """Columns that get a target rate."""
        return (*self.config.hybrid, *self.config.target_rate)

    def with_smoothing(self, smoothing: float) -> LevelEncoderModel:
        """The same counts with another weight of the overall rate."""
        return LevelEncoderModel(
            self.config, {**self.state, "smoothing": float(smoothing)}, self.counts)

    def rates(self, column: str, smoothings: dict[str, float] | None = None) -> DataFrame:
        """``level, n, rate`` of one column; a ``rate`` with each suffix for several smoothings."""
        s = self.state
        smoothings = smoothings or {"": s["smoothing"]}
        one = self.counts.where(
            (F.col("column") == column) & F.col("level").isNotNull())

        def rate(weight: float) -> Column:
            r = (F.col("pos") + F.lit(weight) * F.lit(s["mean"])) / (F.col("n") + F.lit(weight))
            if s["min_category_size"] > 0:
                r = F.when(F.col("n") < s["min_category_size"], s["mean"]).otherwise(r)
            return r

        return one.select(
            "level", "n", *[rate(w).alias(f"rate{x}") for x, w in smoothings.items()])

    def _add_rate(self, df: DataFrame, column: str, spread_by: Sequence[str],
                  smoothings: dict[str, float]) -> DataFrame:
        keyed = df.withColumn("_level", F.col(column).cast("string"))
        rates = self.buckets.get(column) if list(smoothings) == [""] else None
        if rates is None:
            rates = self.rates(column, smoothings).withColumnRenamed("level", "_level")
        values = [f"rate{x}" for x in smoothings]
        joined = lookup_join(keyed, rates, "_level", values, spread_by, stored=True,
                             broadcast_bytes=self.broadcast_bytes)
        mean = F.lit(self.state["mean"])
        return joined.withColumns({
            f"{column}_te{x}": F.coalesce(f"rate{x}", mean) for x in smoothings
        }).drop("_level", *values)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.encoded(dataset, {"": self.state["smoothing"]})

    def encoded(self, dataset: DataFrame, smoothings: dict[str, float]) -> DataFrame:
        """As ``transform``, with rates ``<c>_te<suffix>`` for the smoothing of each suffix."""
        cfg, s = self.config, self.state
        out = dataset
        spread_by = [c for c in (*cfg.inputs, "id") if c in dataset.columns]
        for c in self.rate_columns:
            out = self._add_rate(out, c, spread_by, smoothings)
        new = {f"{c}_is_dominant": is_dominant(c, s["dominant"].get(c))
               for c in (*cfg.dichotomize, *cfg.hybrid)}
        new |= {f"{c}_top": top_or_other(c, s["top"].get(c, [])) for c in cfg.top_k}
        new |= {f"{c}_top": F.col(c).cast("string") for c in cfg.one_hot}
        return out.withColumns(new) if new else out

    def write(self) -> MLWriter:
        return _LevelEncoderWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _LevelEncoderReader(cls)


class _LevelEncoderWriter(MLWriter):
    def __init__(self, instance: LevelEncoderModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:  # noqa: N802 (Spark ML hook)
        m = self.instance
        session = self.sparkSession
        DefaultParamsWriter.saveMetadata(
            m, path, session,
            extraMetadata={"encoding": config_to_json(m.config), "state": m.state})
        wanted = F.col("column").isin(list(m.rate_columns))
        m.counts.where(wanted).sortWithinPartitions("column").write.parquet(f"{path}/levels")


class _LevelEncoderReader(MLReader):
    def __init__(self, cls):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> LevelEncoderModel:
        session = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, session)
        counts = None
        model = self.cls(config_from_json(meta["encoding"]), meta["state"])
        if model.rate_columns:
            counts = session.read.schema(
                "column string, level string, n long, pos long").parquet(f"{path}/levels")
        model.counts = counts
        model._resetUid(meta["uid"])
        return model


def encoder_from_counts(
    counts: DataFrame,
    config: EncodingConfig,
    smoothing: float = 50.0,
    min_category_size: int = 0,
) -> LevelEncoderModel:
    """Fitted encoder out of ``level_counts`` of the training rows.

    What reaches the driver is one row per column, K rows per collapsed column
    and the levels of the one-hot columns, whose number is checked first.
    """
    sizes = {
        r["column"]: r for r in counts.groupBy("column").agg(
            F.count("level").alias("levels"), F.sum("n").alias("n"), F.sum("pos").alias("pos"),
            F.sum(F.when(F.col("level").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
        ).collect()
    }
    if not sizes:
        raise ValueError("there are no training rows")
    wanted = {c: 1 for c in (*config.dichotomize, *config.hybrid)}
    for c, k in config.top_k.items():
        wanted[c] = max(k, wanted.get(c, 0))
    # a slot for every level: the width of the vector is what limits a one-hot column
    wanted |= {c: max(1, sizes[c]["levels"]) for c in config.one_hot}
    best: dict[str, list[str]] = {c: [] for c in wanted}
    if wanted:
        picked = top_levels(counts.where(F.col("column").isin(list(wanted))), wanted)
        for r in sorted(picked.collect(), key=lambda r: r["rank"]):
            best[r["column"]].append(r["level"])
    top = {c: best[c][:k] for c, k in config.top_k.items()}
    slots = {c: sorted(best[c]) for c in config.one_hot}
    for c, kept in top.items():
        rest = [OTHER] if sizes[c]["levels"] > len(kept) or sizes[c]["nulls"] else []
        slots[c] = sorted({*kept, *rest})
    any_column = next(iter(sizes.values()))
    state = {
        "smoothing": float(smoothing),
        "min_category_size": int(min_category_size),
        "mean": any_column["pos"] / any_column["n"],
        "dominant": {c: best[c][0] if best[c] else None
                     for c in (*config.dichotomize, *config.hybrid)},
        "top": top, "slots": slots,
        "n_levels": {c: int(r["levels"]) for c, r in sizes.items()},
    }
    return LevelEncoderModel(config, state, counts)


def assemble_encoder(
    levels: LevelEncoderModel,
    train: DataFrame,
    unknown_slot: bool = False,
    handle_invalid: str = "error",
) -> PipelineModel:
    """All stages from raw columns to ``features``.

    Order: scaled, numeric, dominant flags, target rates, one-hot slots. The
    scaler runs before the joins, so fitting it reads two numeric columns only.
    A level unseen in training gets no one-hot slot, or with ``unknown_slot``
    one of its own. ``handle_invalid`` decides on null numbers.
    """
    cfg = levels.config
    stages, parts = [], []
    if cfg.scaled:
        gather = VectorAssembler(
            inputCols=list(cfg.scaled), outputCol="_to_scale", handleInvalid=handle_invalid)
        scaler = StandardScaler(
            inputCol="_to_scale", outputCol="scaled", withMean=True, withStd=True)
        stages += [gather, scaler.fit(gather.transform(train.select(*cfg.scaled)))]
        parts.append("scaled")
    stages.append(levels)
    parts += [*cfg.numeric]
    parts += [f"{c}_is_dominant" for c in (*cfg.dichotomize, *cfg.hybrid)]
    parts += [f"{c}_te" for c in levels.rate_columns]
    sparse = [*cfg.top_k, *cfg.one_hot]
    if sparse:
        # one model per column: label lists of unequal length cannot share one
        index = PipelineModel([
            StringIndexerModel.from_labels(
                levels.state["slots"][c], inputCol=f"{c}_top", outputCol=f"{c}_idx",
                handleInvalid="keep")
            for c in sparse
        ])
        one_hot = OneHotEncoder(
            inputCols=[f"{c}_idx" for c in sparse], outputCols=[f"{c}_ohe" for c in sparse],
            dropLast=not unknown_slot)
        # the sizes are in the column metadata, so this fit runs no job
        empty = train.sparkSession.createDataFrame([], ", ".join(
            f"`{c}_top` string" for c in sparse))
        stages += [*index.stages, one_hot.fit(index.transform(empty))]
        parts += [f"{c}_ohe" for c in sparse]
    stages.append(VectorAssembler(
        inputCols=parts, outputCol="features", handleInvalid=handle_invalid))
    return PipelineModel(stages)


def encode_smoothings(encoder: PipelineModel, df: DataFrame,
                      smoothings: dict[str, float]) -> DataFrame:
    """``df`` encoded with ``features<suffix>`` for the smoothing of each suffix.

    Only target rates and the assembled vectors depend on the smoothing; all other stages, and
    the lookups of the rates, run once for all.
    """
    levels = next(s for s in encoder.stages if isinstance(s, LevelEncoderModel))
    rates = {f"{c}_te" for c in levels.rate_columns}
    out = df
    for stage in encoder.stages[:-1]:
        out = levels.encoded(out, smoothings) if stage is levels else stage.transform(out)
    last = encoder.stages[-1]
    for x in smoothings:
        columns = [f"{c}{x}" if c in rates else c for c in last.getInputCols()]
        out = last.copy({last.inputCols: columns, last.outputCol: f"features{x}"}).transform(out)
    return out


def encoder_width(levels: LevelEncoderModel, unknown_slot: bool = False) -> int:
    """Length of ``features``, by arithmetic."""
    cfg = levels.config
    slots = sum(len(levels.state["slots"][c]) + int(unknown_slot)
                for c in (*cfg.top_k, *cfg.one_hot))
    return (len(cfg.scaled) + len(cfg.numeric) + len(cfg.dichotomize)
            + len(cfg.hybrid) + len(levels.rate_columns) + slots)


def feature_names(model: PipelineModel, unknown_slot: bool = False) -> list[str]:
    """Names of the entries of ``features``, in order."""
    levels = next(s for s in model.stages if isinstance(s, LevelEncoderModel))
    cfg = levels.config
    names = [*cfg.scaled, *cfg.numeric]
    names += [f"{c}_is_dominant" for c in (*cfg.dichotomize, *cfg.hybrid)]
    names += [f"{c}_te" for c in levels.rate_columns]
    for c in (*cfg.top_k, *cfg.one_hot):
        names += [f"{c}_{v}" for v in levels.state["slots"][c]]
        names += [f"{c}_unknown"] if unknown_slot else []
    return names


class ImpressionEncoder(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of the whole encoding; ``fit`` gives a ``PipelineModel``."""

    encoding = Param(Params._dummy(), "encoding", "configuration as JSON",
                     TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "weight of the overall rate",
                      TypeConverters.toFloat)
    minCategorySize = Param(
        Params._dummy(), "minCategorySize", "smaller levels get the overall rate",
        TypeConverters.toInt)
    unknownSlot = Param(Params._dummy(), "unknownSlot", "one-hot slot for unseen levels",
                        TypeConverters.toBoolean)
    handleInvalid = Param(Params._dummy(), "handleInvalid", "error, skip or keep",
                          TypeConverters.toString)

    @keyword_only
    def __init__(self, *, encoding: str | None = None, smoothing: float = 50.0,
                 minCategorySize: int = 0, unknownSlot: bool = False,  # noqa: N803
                 handleInvalid: str = "error"):  # noqa: N803
        super().__init__()
        given = {k: v for k, v in self._input_kwargs.items() if v is not None}
        self._setDefault(
            encoding=config_to_json(EncodingConfig()), smoothing=50.0, minCategorySize=0,
            unknownSlot=False, handleInvalid="error")
        self._set(**given)

    @classmethod
    def of(cls, config: EncodingConfig, **params) -> ImpressionEncoder:
        """Encoder for a configuration object."""
        return cls(encoding=config_to_json(config), **params)

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        get = self.getOrDefault
        config = config_from_json(get(self.encoding))
        require_columns(dataset, [*config.inputs, config.target])
        counts = materialize(
            level_counts(dataset, config.categorical, config.target), "levels",
            sort_by=("column",))
        levels = encoder_from_counts(
            counts, config, get(self.smoothing), get(self.minCategorySize))
        return assemble_encoder(
            levels, dataset, get(self.unknownSlot), get(self.handleInvalid))


def encoding_plan(spark: SparkSession, config: EncodingConfig | None = None,
                  derived: Sequence[str] = DERIVED) -> DataFrame:
    """``column, strategy, k`` of a configuration.

    ``derived`` names the columns that enter through a feature made of them.
    """
    cfg = config or EncodingConfig()
    rows = [(c, "dichotomize", None) for c in sorted(cfg.dichotomize)]
    rows += [(c, "top_k", k) for c, k in sorted(cfg.top_k.items())]
    rows += [(c, "hybrid", None) for c in sorted(cfg.hybrid)]
    rows += [(c, "target_rate", None) for c in sorted(cfg.target_rate)]
    rows += [(c, "derived", None) for c in sorted(derived)]
    return spark.createDataFrame(rows, "column string, strategy string, k int")


def standardize(df: DataFrame, columns: Sequence[str], output: str = "scaled") -> PipelineModel:
    """Fitted stages that standardise only ``columns`` (sample deviation)."""
    gather = VectorAssembler(inputCols=list(columns), outputCol="_to_scale")
    scaler = StandardScaler(
        inputCol="_to_scale", outputCol=output, withMean=True, withStd=True)
    return PipelineModel([gather, scaler.fit(gather.transform(df.select(*columns)))])


def code_book(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, level, code``: levels of every column numbered in sorted order."""
    levels = materialize(
        level_counts(df, columns).where(F.col("level").isNotNull()).select(
            "column", "level", F.lit(1).cast("long").alias("one")), "levels")
    placed = running_totals(
        levels, "level", ["one"], text_cut_points(levels, "level"), by=["column"])
    return placed.select("column", "level", F.col("one_below").cast("long").alias("code"))


__all__ = [
    "ImpressionEncoder", "LevelEncoderModel", "assemble_encoder", "code_book",
    "encode_smoothings", "encoder_from_counts", "encoder_width", "encoding_plan", "feature_names", "is_dominant",
    "standardize", "top_or_other",
]
