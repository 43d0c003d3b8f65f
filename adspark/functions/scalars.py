"""Small column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_frequency(n: Column | str, is_placeholder: Column | None = None) -> Column:
    """``ln(n + 1)``, an absent count being 0 and a placeholder mapping to 0."""
    value = F.log(F.coalesce(_col(n), F.lit(0)) + 1)
    if is_placeholder is None:
        return value
    return F.when(is_placeholder, F.lit(0.0)).otherwise(value)


def level_label(level: Column | str, mapping: Mapping | None) -> Column:
    """Display label of a level; unmapped levels keep their text."""
    text = _col(level).cast("string")
    if not mapping:
        return text
    pairs = [F.lit(x) for k, v in mapping.items() for x in (str(k), str(v))]
    return F.coalesce(F.create_map(*pairs)[text], text)


def list_position(value: Column | str, order: Sequence[str]) -> Column:
    """Zero-based place in ``order``; values outside it come last."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), _col(value))
    return F.coalesce(F.nullif(place, F.lit(0)) - 1, F.lit(len(order))).cast("int")


def above(score: Column | str, threshold: Column | float) -> Column:
    """1 when the score reaches the threshold, else 0."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (_col(score) >= t).cast("int")


def safe_ratio(num: Column, den: Column) -> Column:
    """``num / den``, 0 when the denominator is 0."""
    return F.when(den == 0, F.lit(0.0)).otherwise(
        num.cast("double") / F.nullif(den, F.lit(0)).cast("double"))


def strip_step_prefix(key: Column | str) -> Column:
    """Drop a leading ``step__`` from a parameter name."""
    return F.regexp_replace(_col(key), "^.*?__", "")
