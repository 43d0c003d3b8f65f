"""Rounding of computed doubles, so that results of two engines compare equal."""

from pyspark.sql import DataFrame, functions as F


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    """Every double column rounded, after the last arithmetic step."""
    return df.select(*[
        F.round(c, digits).alias(c) if t == "double" and (only is None or c in only) else F.col(c)
        for c, t in df.dtypes
    ])
