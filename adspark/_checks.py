"""Argument checks shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    """Required column names that ``df`` does not have, in the given order."""
    present = set(df.columns)
    return [c for c in required if c not in present]


def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Raise ``ValueError`` when a required column is absent."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"columns not found: {absent}; available: {df.columns}")


def require_names(names, what: str = "columns") -> list[str]:
    """A non-empty list of strings."""
    if isinstance(names, str) or not isinstance(names, (list, tuple)):
        raise TypeError(f"'{what}' must be a list or tuple of strings")
    if not names:
        raise ValueError(f"'{what}' must contain at least one name")
    if not all(isinstance(n, str) for n in names):
        raise TypeError(f"every element of '{what}' must be a string")
    return list(names)


def require_positive_int(value, what: str) -> int:
    """A positive ``int`` (booleans are refused)."""
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"'{what}' must be a positive integer")
    return value


def require_number(value, what: str, low: float, high: float,
                   closed: bool = False) -> float:
    """A number inside ``(low, high)``, or ``[low, high]`` when ``closed``."""
    ok = isinstance(value, (int, float)) and not isinstance(value, bool)
    if ok:
        ok = low <= value <= high if closed else low < value < high
    if not ok:
        span = f"[{low}, {high}]" if closed else f"({low}, {high})"
        raise ValueError(f"'{what}' must be a number in {span}")
    return float(value)


def require_choice(value, what: str, choices: Iterable) -> None:
    """A value out of a fixed set."""
    choices = tuple(choices)
    if value not in choices:
        raise ValueError(f"'{what}' must be one of {list(choices)}, got {value!r}")


def require_rows(df: DataFrame, what: str = "relation") -> DataFrame:
    """Raise ``ValueError`` on an empty input; this runs a one-row job."""
    if df.isEmpty():
        raise ValueError(f"the {what} has no rows")
    return df
